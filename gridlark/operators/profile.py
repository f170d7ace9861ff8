"""Profiles and grades of series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import correlation
from ..sources.panel import CPU, MEM
from .prepare import by_time
from .selection import percentile_columns

# Tier rules (lifespan in hours, records, completeness), best tier first.
TIERS_A = ((168, 1700, 0.85), (120, 1000, 0.70), (72, 500, 0.60), (24, 140, 0.50), (6, 30, 0.40))
TIERS_B = ((168, 300, 0.85), (120, 200, 0.75), (72, 100, 0.60), (24, 40, 0.50), (6, 15, 0.40))


def series_stats(panel: DataFrame) -> DataFrame:
    """Records, first and last time, completeness of each metric, lifespan in hours, mean completeness."""
    share = lambda c: F.avg(F.col(c).isNotNull().cast("double"))
    s = panel.groupBy("container_id").agg(F.count("*").alias("record_count"), F.min("time_stamp").alias("ts_min"), F.max("time_stamp").alias("ts_max"), share(CPU).alias("cpu_completeness"), share(MEM).alias("mem_completeness"))
    return s.withColumn("lifespan_hours", (F.col("ts_max") - F.col("ts_min")) / 3600.0).withColumn("avg_completeness", (F.col("cpu_completeness") + F.col("mem_completeness")) / 2)


def tier(stats: DataFrame, rules: tuple = TIERS_B) -> DataFrame:
    """``tier`` 1 (best) to 5 by the first rule that holds, else 0."""
    life, n, full = F.coalesce("lifespan_hours", F.lit(0.0)), F.coalesce("record_count", F.lit(0)), F.coalesce("avg_completeness", F.lit(0.5))
    out = F.lit(0)
    for k in range(len(rules), 0, -1):
        h, r, c = rules[k - 1]
        out = F.when((life >= h) & (n >= r) & (full >= c), k).otherwise(out)
    return stats.withColumn("tier", out)


def tier_pools(tiered: DataFrame) -> DataFrame:
    """Series of each tier 0 to 5, and of the pools 1-3, 1-4 and 1-5 that hold it."""
    counts = tiered.groupBy("tier").agg(F.count("*").alias("n"))
    every = tiered.sparkSession.range(6).select(F.col("id").cast("int").alias("tier"))
    got = every.join(counts, "tier", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    w = Window.orderBy("tier").rowsBetween(Window.unboundedPreceding, 0)  # six rows
    return got.withColumn("pool", F.when(F.col("tier") > 0, F.sum(F.when(F.col("tier") > 0, F.col("n"))).over(w)))


def interval_regularity(panel: DataFrame) -> DataFrame:
    """Most common gap, to 10 s, of each series; share of gaps within a tenth of it; grade."""
    gaps = panel.withColumn("gap", F.col("time_stamp") - F.lag("time_stamp").over(by_time())).filter("gap is not null")
    gaps = gaps.withColumn("rounded", (F.bround(F.col("gap") / 10.0) * 10).cast("long"))
    counts = gaps.groupBy("container_id", "rounded").agg(F.count("*").alias("n"))
    mode = counts.groupBy("container_id").agg(F.min(F.struct(-F.col("n"), F.col("rounded").alias("mode_s")))["mode_s"].alias("mode_s"))
    near = F.abs(F.col("gap") - F.col("mode_s")) <= 0.1 * F.col("mode_s")
    out = gaps.join(mode, "container_id").groupBy("container_id", "mode_s").agg((100 * F.avg(near.cast("double"))).alias("regular_pct"))
    return out.withColumn("grade", F.when(F.col("regular_pct") > 80, "GOOD").when(F.col("regular_pct") > 50, "FAIR").otherwise("POOR"))


def grade(share: Column) -> Column:
    return F.when(share >= 95, "A").when(share >= 80, "B").when(share >= 60, "C").otherwise("D")


def completeness_grades(panel: DataFrame, metrics: tuple[str, ...] = (CPU, MEM)) -> DataFrame:
    shares = panel.agg(*[(100 * F.avg(F.col(m).isNotNull().cast("double"))).alias(m) for m in metrics])
    out = shares.unpivot([], list(metrics), "metric", "filled_pct")
    return out.withColumn("grade", grade(F.col("filled_pct")))


def resource_summary(panel: DataFrame, metrics: tuple[str, ...] = (CPU, MEM)) -> DataFrame:
    """Moments and percentiles of each metric over its valid range; the percentiles are exact however many values there are."""
    long = panel.unpivot([], list(metrics), "metric", "value").filter("value between 0 and 100")
    q = percentile_columns(long, ["metric"], "value", {f"p{int(100 * p):02d}": p for p in (0.25, 0.5, 0.75, 0.95)})
    return long.groupBy("metric").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("lo"), F.max("value").alias("hi")).join(q, "metric")


def cpu_mem_correlation(panel: DataFrame) -> DataFrame:
    return panel.agg(correlation(F.col(CPU), F.col(MEM)).alias("corr"))


def scan_stats(panel: DataFrame) -> DataFrame:
    hours = (F.max("time_stamp") - F.min("time_stamp")) / 3600.0
    null = lambda c: 100 * F.avg(F.col(c).isNull().cast("double"))
    return panel.agg(F.count("*").alias("n_rows"), F.countDistinct("container_id").alias("n_series"), null(CPU).alias("cpu_null_pct"), null(MEM).alias("mem_null_pct"), hours.alias("hours"), (hours / 24).alias("days"))


def go_no_go(panel: DataFrame, min_series: int = 100, min_days: float = 7, min_filled: float = 80) -> DataFrame:
    """Three checks, and GO for all, CONDITIONAL GO for two, else NO-GO."""
    s = scan_stats(panel)
    checks = [F.col("n_series") >= min_series, F.col("days") >= min_days, 100 - F.col("cpu_null_pct") >= min_filled]
    passed = sum((c.cast("int") for c in checks[1:]), checks[0].cast("int"))
    return s.select(passed.alias("passed"), F.when(passed == 3, "GO").when(passed == 2, "CONDITIONAL GO").otherwise("NO-GO").alias("verdict"))


def mode_machine(raw: DataFrame) -> DataFrame:
    """Most frequent machine of each series, the smallest name among equals."""
    counts = raw.groupBy("container_id", "machine_id").agg(F.count("*").alias("n"))
    best = F.min(F.struct(-F.col("n"), F.col("machine_id").alias("m")))
    return counts.groupBy("container_id").agg(best["m"].alias("machine_id"))


def workload_profile(panel: DataFrame) -> DataFrame:
    """Mean, deviation, range and variation of both metrics of each series; series with a NULL among them go."""
    aggs = []
    for m, c in (("cpu", CPU), ("mem", MEM)):
        aggs += [F.avg(c).alias(f"{m}_mean"), F.stddev_samp(c).alias(f"{m}_std"), F.min(c).alias(f"{m}_min"), F.max(c).alias(f"{m}_max")]
    out = panel.groupBy("container_id").agg(*aggs)
    out = out.withColumns({f"{m}_range": F.col(f"{m}_max") - F.col(f"{m}_min") for m in ("cpu", "mem")})
    return out.withColumns({f"{m}_cv": F.col(f"{m}_std") / F.greatest(F.col(f"{m}_mean"), F.lit(0.1)) for m in ("cpu", "mem")}).dropna()


def workload_name(cpu_mean: Column, cpu_std: Column, mem_mean: Column) -> Column:
    """Class of a workload by the first rule that holds."""
    return F.when(cpu_std > 15, "VOLATILE").when(cpu_mean > 50, "CPU_HEAVY").when(mem_mean > 70, "MEM_HEAVY").when((cpu_mean < 10) & (mem_mean < 30), "IDLE").otherwise("BALANCED")


def with_workload(panel: DataFrame) -> DataFrame:
    """``panel`` with ``workload``, the class of its series by :func:`workload_profile`'s moments; series without a profile go.

    From the sort by series that resampling uses, so that nothing is joined to the longer tables made of the panel.
    """
    whole = by_time().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = panel.withColumns({f"{m}_{n}*": f(c).over(whole) for m, c in (("cpu", CPU), ("mem", MEM)) for n, f in (("mean", F.avg), ("std", F.stddev_samp))})
    rows = rows.filter("`cpu_std*` is not null and `mem_std*` is not null").withColumn("workload", workload_name(F.col("cpu_mean*"), F.col("cpu_std*"), F.col("mem_mean*")))
    return rows.drop(*[f"{m}_{n}*" for m in ("cpu", "mem") for n in ("mean", "std")])


def vm_scan(panel: DataFrame) -> DataFrame:
    """Records, moments, variation (NULL for a mean not above 0) and lag-1 correlation of each series."""
    lagged = panel.withColumn("before", F.lag(CPU).over(by_time()))
    out = lagged.groupBy("container_id").agg(F.count(CPU).alias("n"), F.avg(CPU).alias("mean"), F.stddev_samp(CPU).alias("std"), F.max(CPU).alias("hi"), correlation(F.col("before"), F.col(CPU)).alias("acf1"))
    return out.withColumn("cv", F.when(F.col("mean") > 0, F.col("std") / F.col("mean")))


def active_series(panel: DataFrame, mean: float = 15, std: float = 3) -> DataFrame:
    s = panel.groupBy("container_id").agg(F.avg(CPU).alias("mean"), F.stddev_samp(CPU).alias("std"))
    return s.filter((F.col("mean") > mean) & (F.col("std") > std))


def split_summary(split: DataFrame, cluster: str) -> DataFrame:
    """Rows of each split and class, and their share of the split."""
    got = split.groupBy("split", cluster).agg(F.count("*").alias("n"))
    return got.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("split")))


def top_series_by_volume(panel: DataFrame, n: int = 20) -> DataFrame:
    return panel.groupBy("container_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "container_id").limit(n)

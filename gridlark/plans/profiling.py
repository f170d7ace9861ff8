"""Queries: ingest, profiles, resampling, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import prepare, profile
from ..registry import query
from ..sources import panel as src
from ..sources.panel import CPU, MEM
from .fixtures import GRID, PANEL, RAW, events_panel, grid, panel, r, rounded


def sql(prefix: str, rest: str) -> str:
    return f"WITH {prefix} {rest}"


_SHORT = {CPU: "cpu", MEM: "mem"}


@query("dedup_panel", sql(PANEL, f"SELECT container_id, machine_id, time_stamp, {r('cpu', 'cpu')}, {r('mem', 'mem')}, event_id FROM panel"))
def dedup_panel(spark, sf_dir):
    return rounded(panel(spark, sf_dir).withColumnsRenamed(_SHORT))


@query("adapt_schema", f"SELECT user_id::VARCHAR AS container_id, floor(epoch(ts))::BIGINT AS time_stamp, {r('value::DOUBLE', 'cpu_util_percent')}, 0.0::DOUBLE AS mem_util_percent FROM events")
def adapt_schema(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").cast("string").alias("cols"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("date"), F.col("value").cast("double").alias("data"))
    return rounded(src.adapt_schema(e, {"cols": "container_id", "date": "time_stamp", "data": CPU}, (MEM,)))


@query("normalise_id", "SELECT DISTINCT 'bb_' || regexp_replace(trim(user_id::DOUBLE::VARCHAR), '\\.0$', '') AS container_id FROM events")
def normalise_id(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(src.normalise_id(F.col("user_id").cast("double"), "bb_").alias("container_id")).distinct()


@query("detect_epoch_unit", sql(RAW, "SELECT machine_id, median(time_stamp) AS median_ts, CASE WHEN median(time_stamp) > 1e12 THEN 'ms' WHEN median(time_stamp) > 9e8 AND median(time_stamp) < 2.3e9 THEN 's' ELSE 'unknown' END AS unit FROM raw GROUP BY 1"))
def detect_epoch_unit(spark, sf_dir):
    return src.detect_epoch_unit(events_panel(spark, sf_dir), by=["machine_id"])


@query("vm_panel", sql(RAW, f"SELECT container_id, time_stamp, {r('cpu', 'cpu')}, {r('greatest(0.0, least(100.0, 100 * mem / 100))', 'mem')} FROM raw WHERE mem IS NOT NULL QUALIFY count(*) OVER (PARTITION BY container_id) >= 60"))
def vm_panel(spark, sf_dir):
    e = events_panel(spark, sf_dir).select("container_id", F.col("time_stamp").alias("ts"), F.col(CPU).alias("cpu"), F.col(MEM).alias("used"), F.lit(100.0).alias("cap"))
    return rounded(src.vm_panel(e, "s", 60).withColumnsRenamed(_SHORT))


@query("bernoulli_sample", sql(RAW, "SELECT event_id, container_id FROM raw WHERE ('0x' || substr(md5(event_id::VARCHAR), 1, 8))::BIGINT < 42949672"))
def bernoulli_sample(spark, sf_dir):
    return src.bernoulli_sample(events_panel(spark, sf_dir), F.col("event_id")).select("event_id", "container_id")


@query("sample_series", sql(RAW, "SELECT event_id, container_id FROM raw WHERE container_id IN (SELECT container_id FROM (SELECT DISTINCT container_id FROM raw) ORDER BY md5(container_id), container_id LIMIT 20)"))
def sample_series(spark, sf_dir):
    return src.sample_series(events_panel(spark, sf_dir), 20).select("event_id", "container_id")


@query("asof_resample", sql(GRID, f"SELECT container_id, time_stamp, {r('cpu', 'cpu')}, {r('mem', 'mem')} FROM grid"))
def asof_resample(spark, sf_dir):
    return rounded(grid(spark, sf_dir).withColumnsRenamed(_SHORT))


@query("valid_range_filter", sql(PANEL, "SELECT machine_id, count(*)::BIGINT AS n FROM panel WHERE cpu BETWEEN 0 AND 100 AND mem BETWEEN 0 AND 100 GROUP BY 1"))
def valid_range_filter(spark, sf_dir):
    return panel(spark, sf_dir).filter(F.col(CPU).between(0, 100) & F.col(MEM).between(0, 100)).groupBy("machine_id").agg(F.count("*").alias("n"))


@query("clip_metrics", f"SELECT event_id, {r('greatest(0.0, least(100.0, value::DOUBLE))', 'cpu')} FROM events")
def clip_metrics(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("value").cast("double").alias("cpu"))
    return rounded(prepare.clip_metrics(e, ("cpu",)))


_STATS = """, stats AS (SELECT container_id, count(*)::BIGINT AS record_count, min(time_stamp) AS ts_min, max(time_stamp) AS ts_max, avg((cpu IS NOT NULL)::INT) AS cpu_completeness,
  avg((mem IS NOT NULL)::INT) AS mem_completeness, (max(time_stamp) - min(time_stamp)) / 3600.0 AS lifespan_hours, (avg((cpu IS NOT NULL)::INT) + avg((mem IS NOT NULL)::INT)) / 2 AS avg_completeness FROM panel GROUP BY 1)"""


@query("series_stats", sql(PANEL + _STATS, f"SELECT container_id, record_count, ts_min, ts_max, {r('cpu_completeness', 'cpu_completeness')}, {r('mem_completeness', 'mem_completeness')}, {r('lifespan_hours', 'lifespan_hours')}, {r('avg_completeness', 'avg_completeness')} FROM stats"))
def series_stats(spark, sf_dir):
    return rounded(profile.series_stats(panel(spark, sf_dir)))


def _tiers(rules) -> str:
    cases = " ".join(f"WHEN lifespan_hours >= {h} AND record_count >= {n} AND avg_completeness >= {c} THEN {k}" for k, (h, n, c) in enumerate(rules, 1))
    return f"CASE {cases} ELSE 0 END"


@query("tier_series", sql(PANEL + _STATS, f"SELECT container_id, {_tiers(profile.TIERS_A)} AS tier_a, {_tiers(profile.TIERS_B)} AS tier_b FROM stats"))
def tier_series(spark, sf_dir):
    s = profile.tier(profile.series_stats(panel(spark, sf_dir)), profile.TIERS_A).withColumnRenamed("tier", "tier_a")
    return rounded(profile.tier(s, profile.TIERS_B).withColumnRenamed("tier", "tier_b").select("container_id", "tier_a", "tier_b"))


@query("tier_pools", sql(PANEL + _STATS, f""", tiered AS (SELECT {_tiers(profile.TIERS_B)} AS tier FROM stats), c AS (SELECT t.tier, count(x.tier)::BIGINT AS n FROM (SELECT unnest(range(6)) AS tier) t LEFT JOIN tiered x ON t.tier = x.tier GROUP BY 1)
  SELECT tier::BIGINT AS tier, n, CASE WHEN tier > 0 THEN (sum(CASE WHEN tier > 0 THEN n END) OVER (ORDER BY tier))::BIGINT END AS pool FROM c"""))
def tier_pools(spark, sf_dir):
    return rounded(profile.tier_pools(profile.tier(profile.series_stats(panel(spark, sf_dir)))))


@query("semi_eligible", sql(PANEL + _STATS, f"SELECT event_id, container_id FROM panel WHERE container_id IN (SELECT container_id FROM stats WHERE {_tiers(profile.TIERS_B)} BETWEEN 1 AND 4)"))
def semi_eligible(spark, sf_dir):
    p = panel(spark, sf_dir)
    good = profile.tier(profile.series_stats(p)).filter("tier between 1 and 4")
    return p.join(good, "container_id", "left_semi").select("event_id", "container_id")


@query("interval_regularity", sql(PANEL, f""", gaps AS (SELECT container_id, time_stamp - lag(time_stamp) OVER (PARTITION BY container_id ORDER BY time_stamp) AS gap FROM panel), g AS (SELECT container_id, gap, (round_even((gap / 10.0)::DECIMAL(18, 1), 0) * 10)::BIGINT AS rounded FROM gaps WHERE gap IS NOT NULL),
  m AS (SELECT container_id, rounded AS mode_s FROM (SELECT container_id, rounded, row_number() OVER (PARTITION BY container_id ORDER BY count(*) DESC, rounded) AS k FROM g GROUP BY 1, 2) WHERE k = 1),
  s AS (SELECT g.container_id, mode_s, 100 * avg((abs(gap - mode_s) <= 0.1 * mode_s)::INT) AS regular_pct FROM g JOIN m USING (container_id) GROUP BY 1, 2)
  SELECT container_id, mode_s, {r('regular_pct', 'regular_pct')}, CASE WHEN regular_pct > 80 THEN 'GOOD' WHEN regular_pct > 50 THEN 'FAIR' ELSE 'POOR' END AS grade FROM s"""))
def interval_regularity(spark, sf_dir):
    return rounded(profile.interval_regularity(panel(spark, sf_dir)))


_GRADE = "CASE WHEN filled_pct >= 95 THEN 'A' WHEN filled_pct >= 80 THEN 'B' WHEN filled_pct >= 60 THEN 'C' ELSE 'D' END AS grade"


@query("completeness_grades", sql(PANEL, f", s AS (SELECT 'cpu' AS metric, 100 * avg((cpu IS NOT NULL)::INT) AS filled_pct FROM panel UNION ALL SELECT 'mem', 100 * avg((mem IS NOT NULL)::INT) FROM panel) SELECT metric, {r('filled_pct', 'filled_pct')}, {_GRADE} FROM s"))
def completeness_grades(spark, sf_dir):
    return rounded(profile.completeness_grades(panel(spark, sf_dir).withColumnsRenamed(_SHORT), ("cpu", "mem")))


_SUMMARY = ", ".join([r("avg(v)", "mean"), r("stddev_samp(v)", "std"), r("min(v)", "lo"), r("max(v)", "hi")] + [r(f"quantile_cont(v, {p})", f"p{int(p * 100):02d}") for p in (0.25, 0.5, 0.75, 0.95)])


@query("resource_summary", sql(PANEL, f", u AS (SELECT 'cpu' AS metric, cpu AS v FROM panel UNION ALL SELECT 'mem', mem FROM panel) SELECT metric, count(*)::BIGINT AS n, {_SUMMARY} FROM u WHERE v BETWEEN 0 AND 100 GROUP BY 1"))
def resource_summary(spark, sf_dir):
    return rounded(profile.resource_summary(panel(spark, sf_dir).withColumnsRenamed(_SHORT), ("cpu", "mem")))


@query("cpu_mem_correlation", sql(PANEL, f"SELECT {r('covar_samp(cpu, mem) / nullif(stddev_samp(cpu) * stddev_samp(mem), 0)', 'corr')} FROM panel WHERE cpu IS NOT NULL AND mem IS NOT NULL"))
def cpu_mem_correlation(spark, sf_dir):
    return rounded(profile.cpu_mem_correlation(panel(spark, sf_dir)))


_SCAN = "SELECT count(*)::BIGINT AS n_rows, count(DISTINCT container_id)::BIGINT AS n_series, 100 * avg((cpu IS NULL)::INT) AS cpu_null_pct, 100 * avg((mem IS NULL)::INT) AS mem_null_pct, (max(time_stamp) - min(time_stamp)) / 3600.0 AS hours FROM panel"


@query("scan_stats", sql(PANEL, f", s AS ({_SCAN}) SELECT n_rows, n_series, {r('cpu_null_pct', 'cpu_null_pct')}, {r('mem_null_pct', 'mem_null_pct')}, {r('hours', 'hours')}, {r('hours / 24', 'days')} FROM s"))
def scan_stats(spark, sf_dir):
    return rounded(profile.scan_stats(panel(spark, sf_dir)))


@query("go_no_go", sql(PANEL, f", s AS ({_SCAN}), c AS (SELECT (n_series >= 100)::INT + (hours / 24 >= 7)::INT + (100 - cpu_null_pct >= 80)::INT AS passed FROM s) SELECT passed::BIGINT AS passed, CASE passed WHEN 3 THEN 'GO' WHEN 2 THEN 'CONDITIONAL GO' ELSE 'NO-GO' END AS verdict FROM c"))
def go_no_go(spark, sf_dir):
    return rounded(profile.go_no_go(panel(spark, sf_dir)))


@query("mode_machine", sql(RAW, "SELECT container_id, machine_id FROM (SELECT container_id, machine_id, row_number() OVER (PARTITION BY container_id ORDER BY count(*) DESC, machine_id) AS k FROM raw GROUP BY 1, 2) WHERE k = 1"))
def mode_machine(spark, sf_dir):
    return profile.mode_machine(events_panel(spark, sf_dir))


_PROFILE = ", profile AS (SELECT container_id, " + ", ".join(f"avg({m}) AS {m}_mean, stddev_samp({m}) AS {m}_std, min({m}) AS {m}_min, max({m}) AS {m}_max, max({m}) - min({m}) AS {m}_range, stddev_samp({m}) / greatest(avg({m}), 0.1) AS {m}_cv" for m in ("cpu", "mem")) + " FROM panel GROUP BY 1)"
_PROFILE_OUT = ", ".join(r(f"{m}_{k}", f"{m}_{k}", 9) for m in ("cpu", "mem") for k in ("mean", "std", "min", "max", "range", "cv"))


@query("workload_profile", sql(PANEL + _PROFILE, f"SELECT container_id, {_PROFILE_OUT} FROM profile WHERE cpu_std IS NOT NULL AND mem_std IS NOT NULL"))
def workload_profile(spark, sf_dir):
    return rounded(profile.workload_profile(panel(spark, sf_dir)), 9)


_NAME = "CASE WHEN cpu_std > 15 THEN 'VOLATILE' WHEN cpu_mean > 50 THEN 'CPU_HEAVY' WHEN mem_mean > 70 THEN 'MEM_HEAVY' WHEN cpu_mean < 10 AND mem_mean < 30 THEN 'IDLE' ELSE 'BALANCED' END"


@query("workload_names", sql(PANEL + _PROFILE, f"SELECT {_NAME} AS workload, count(*)::BIGINT AS n FROM profile WHERE cpu_std IS NOT NULL AND mem_std IS NOT NULL GROUP BY 1"))
def workload_names(spark, sf_dir):
    p = profile.workload_profile(panel(spark, sf_dir))
    return p.groupBy(profile.workload_name(F.col("cpu_mean"), F.col("cpu_std"), F.col("mem_mean")).alias("workload")).agg(F.count("*").alias("n"))


@query("join_series_attributes", sql(PANEL, "SELECT p.event_id, coalesce(c_mktsegment, 'UNKNOWN') AS segment FROM panel p LEFT JOIN customer c ON p.container_id = 'c_' || c_custkey"))
def join_series_attributes(spark, sf_dir):
    attrs = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat(F.lit("c_"), "c_custkey").alias("container_id"), F.col("c_mktsegment").alias("segment"))
    return panel(spark, sf_dir).join(attrs, "container_id", "left").select("event_id", F.coalesce("segment", F.lit("UNKNOWN")).alias("segment"))


_SPLIT = GRID + ", b AS (SELECT min(time_stamp) AS t0, max(time_stamp) AS t1 FROM grid), split AS (SELECT g.*, CASE WHEN time_stamp < t0 + 0.70 * (t1 - t0) THEN 'train' WHEN time_stamp < t0 + 0.85 * (t1 - t0) THEN 'val' ELSE 'test' END AS split FROM grid g, b)"


@query("temporal_split", sql(_SPLIT, "SELECT container_id, time_stamp, split FROM split"))
def temporal_split(spark, sf_dir):
    return prepare.temporal_split(grid(spark, sf_dir)).select("container_id", "time_stamp", "split")


@query("read_panel_split_order", sql(_SPLIT, "SELECT split, lo, hi, coalesce(lo > lag(hi) OVER (ORDER BY CASE split WHEN 'train' THEN 0 WHEN 'val' THEN 1 ELSE 2 END), true) AS in_order FROM (SELECT split, min(time_stamp) AS lo, max(time_stamp) AS hi FROM split GROUP BY 1)"))
def read_panel_split_order(spark, sf_dir):
    return prepare.split_order_check(prepare.temporal_split(grid(spark, sf_dir)))


@query("split_manifest", sql(_SPLIT, "SELECT split, count(*)::BIGINT AS n_rows, count(DISTINCT container_id)::BIGINT AS n_series, min(time_stamp) AS lo, max(time_stamp) AS hi FROM split GROUP BY 1"))
def split_manifest(spark, sf_dir):
    return prepare.split_manifest(prepare.temporal_split(grid(spark, sf_dir)))


@query("union_splits", sql(_SPLIT, "SELECT split, count(*)::BIGINT AS n, count(cpu)::BIGINT AS n_cpu FROM split GROUP BY 1"))
def union_splits(spark, sf_dir):
    s = prepare.temporal_split(grid(spark, sf_dir))
    parts = [s.filter(F.col("split") == k).drop("split").withColumn("split", F.lit(k)) for k in ("train", "val", "test")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("split").agg(F.count("*").alias("n"), F.count(CPU).alias("n_cpu"))


@query("split_summary", sql(_SPLIT + _PROFILE, f", n AS (SELECT split, {_NAME} AS workload, count(*)::BIGINT AS n FROM split JOIN profile USING (container_id) WHERE cpu_std IS NOT NULL AND mem_std IS NOT NULL GROUP BY 1, 2) SELECT split, workload, n, {r('n / sum(n) OVER (PARTITION BY split)', 'share')} FROM n"))
def split_summary(spark, sf_dir):
    p = profile.workload_profile(panel(spark, sf_dir))
    named = p.select("container_id", profile.workload_name(F.col("cpu_mean"), F.col("cpu_std"), F.col("mem_mean")).alias("workload"))
    return rounded(profile.split_summary(prepare.temporal_split(grid(spark, sf_dir)).join(named, "container_id"), "workload"))


@query("grid_regularity_check", sql(GRID, f", g AS (SELECT container_id, time_stamp - lag(time_stamp) OVER (PARTITION BY container_id ORDER BY time_stamp) AS gap FROM grid) SELECT container_id, {r('stddev_pop(gap)', 'gap_std')}, coalesce(stddev_pop(gap) < 1, false) AS regular FROM g GROUP BY 1"))
def grid_regularity_check(spark, sf_dir):
    return rounded(prepare.grid_regularity(grid(spark, sf_dir)))


_LAG = ", lagged AS (SELECT *, lag(cpu) OVER (PARTITION BY container_id ORDER BY time_stamp) AS before FROM panel)"
_ACF1 = "covar_samp(before, cpu) / nullif(stddev_samp(before) * stddev_samp(CASE WHEN before IS NOT NULL THEN cpu END), 0)"


@query("vm_scan", sql(PANEL + _LAG, f"SELECT container_id, count(cpu)::BIGINT AS n, {r('avg(cpu)', 'mean', 9)}, {r('stddev_samp(cpu)', 'std', 9)}, {r('max(cpu)', 'hi', 9)}, {r(_ACF1, 'acf1', 9)}, {r('CASE WHEN avg(cpu) > 0 THEN stddev_samp(cpu) / avg(cpu) END', 'cv', 9)} FROM lagged GROUP BY 1"))
def vm_scan(spark, sf_dir):
    return rounded(profile.vm_scan(panel(spark, sf_dir)), 9)


@query("active_series_filter", sql(PANEL, f"SELECT container_id, {r('avg(cpu)', 'mean', 9)}, {r('stddev_samp(cpu)', 'std', 9)} FROM panel GROUP BY 1 HAVING avg(cpu) > 8 AND stddev_samp(cpu) > 3"))
def active_series_filter(spark, sf_dir):
    return rounded(profile.active_series(panel(spark, sf_dir), mean=8), 9)


@query("top_series_by_volume", sql(PANEL, "SELECT container_id, count(*)::BIGINT AS n FROM panel GROUP BY 1 ORDER BY n DESC, container_id LIMIT 20"))
def top_series_by_volume(spark, sf_dir):
    return profile.top_series_by_volume(panel(spark, sf_dir))


@query("set_consistency", sql(PANEL, "SELECT (SELECT count(*) FROM (SELECT container_id FROM panel INTERSECT SELECT 'c_' || c_custkey FROM customer))::BIGINT AS both, (SELECT count(*) FROM (SELECT container_id FROM panel EXCEPT SELECT 'c_' || c_custkey FROM customer))::BIGINT AS only_panel, (SELECT count(*) FROM (SELECT 'c_' || c_custkey FROM customer EXCEPT SELECT container_id FROM panel))::BIGINT AS only_customers"))
def set_consistency(spark, sf_dir):
    a = panel(spark, sf_dir).select("container_id")
    b = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat(F.lit("c_"), "c_custkey").alias("container_id"))
    both = a.select("container_id", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(b.select("container_id", F.lit(0).alias("a"), F.lit(1).alias("b"))).groupBy("container_id").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return both.agg(*[F.count_if((F.col("a") == a) & (F.col("b") == b)).alias(name) for a, b, name in ((1, 1, "both"), (1, 0, "only_panel"), (0, 1, "only_customers"))])


@query("read_metric_json", f"SELECT event_type, count(*)::BIGINT AS n, {r('avg(coalesce(json_extract_string(props, ' + chr(39) + '$.k' + chr(39) + ')::DOUBLE, 0))', 'mean_k')} FROM events GROUP BY 1")
def read_metric_json(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("j", F.from_json("props", "k double, value double"))
    return rounded(e.groupBy("event_type").agg(F.count("*").alias("n"), F.avg(F.coalesce("j.k", "j.value", F.lit(0.0))).alias("mean_k")))


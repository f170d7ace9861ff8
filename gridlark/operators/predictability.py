"""How predictable a series is."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import ratio
from ..scratch import materialise
from .prepare import by_time
from .selection import exact_percentiles


def series_cv(panel: DataFrame, metric: str) -> DataFrame:
    """Deviation over mean; NULL for fewer than two values or a mean near 0."""
    m, s = F.avg(metric), F.stddev_samp(metric)
    return panel.groupBy("container_id").agg(F.when((F.count(metric) >= 2) & (m >= 1e-6), s / F.nullif(m, F.lit(0.0))).alias("cv"))


def acf_global_mean(panel: DataFrame, metric: str, lags: tuple[int, ...]) -> DataFrame:
    """Autocorrelation around the series' own mean, for series longer than the largest lag by more than six."""
    c = panel.withColumn("c", F.col(metric) - F.avg(metric).over(Window.partitionBy("container_id")))
    c = c.withColumns({f"g{k}": F.col("c") * F.lag("c", k).over(by_time()) for k in lags})
    got = c.groupBy("container_id").agg(F.count(metric).alias("n"), F.sum(F.col("c") * F.col("c")).alias("g0"), *[F.sum(f"g{k}").alias(f"g{k}") for k in lags])
    return got.filter(F.col("n") > max(lags) + 6).select("container_id", *[ratio(F.col(f"g{k}"), F.col("g0")).alias(f"acfg_{k}") for k in lags])


def hurst_rs(panel: DataFrame, metric: str, powers: tuple[int, ...] = (3, 4, 5, 6, 7), least: int = 100) -> DataFrame:
    """Rescaled range exponent: slope of log mean R/S over log chunk size, by least squares; whole chunks only."""
    rows = panel.filter(F.col(metric).isNotNull()).withColumn("pos", F.row_number().over(by_time()) - 1).withColumn("n", F.count("*").over(Window.partitionBy("container_id"))).filter(F.col("n") >= least)
    rows = rows.withColumn("size", F.explode(F.array(*[F.lit(2**j) for j in powers]))).withColumn("chunk", F.floor(F.col("pos") / F.col("size"))).filter((F.col("chunk") + 1) * F.col("size") <= F.col("n"))
    part = Window.partitionBy("container_id", "size", "chunk")
    rows = rows.withColumn("d", F.col(metric) - F.avg(metric).over(part)).withColumn("z", F.sum("d").over(part.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    chunks = rows.groupBy("container_id", "size", "chunk").agg((F.max("z") - F.min("z")).alias("r"), F.stddev_pop(metric).alias("s")).filter("s > 1e-9")
    mean = chunks.groupBy("container_id", "size").agg(F.avg(F.col("r") / F.col("s")).alias("rs")).filter("rs > 0")
    return mean.groupBy("container_id").agg(F.regr_slope(F.log("rs"), F.log("size")).alias("hurst"), F.count("*").alias("n_sizes")).filter("n_sizes >= 3").drop("n_sizes")


def predictability_table(panel: DataFrame, metric: str, lags: tuple[int, ...]) -> DataFrame:
    """One row: medians over all series of variation, Hurst exponent and autocorrelations; NULL where no series has one."""
    long = lambda df: df.unpivot(["container_id"], [c for c in df.columns if c != "container_id"], "measure", "value")
    names = ["cv", "hurst", *[f"acfg_{k}" for k in lags]]
    rows = long(series_cv(panel, metric)).unionByName(long(hurst_rs(panel, metric))).unionByName(long(acf_global_mean(panel, metric, lags)))
    middle = exact_percentiles(materialise(rows.select("measure", "value"), "measures"), ["measure"], "value", (0.5,))
    return middle.agg(*[F.max(F.when(F.col("measure") == n, F.col("percentile"))).alias(f"median_{n.replace('acfg', 'acf')}") for n in names])


def spectral_omega(panel: DataFrame, metric: str, periods: tuple[int, ...] = (2, 3, 4, 6, 8, 12, 24, 48)) -> DataFrame:
    """One less the entropy of the power at a few periods over its largest value: 1 for one period alone, 0 for equal powers."""
    c = panel.withColumn("pos", F.row_number().over(by_time()) - 1).withColumn("c", F.col(metric) - F.avg(metric).over(Window.partitionBy("container_id")))
    c = c.withColumn("period", F.explode(F.array(*map(F.lit, periods))))
    turn = 2 * 3.141592653589793 * F.col("pos") / F.col("period")
    power = c.groupBy("container_id", "period").agg(F.sum(F.col("c") * F.cos(turn)).alias("a"), F.sum(F.col("c") * F.sin(turn)).alias("b")).withColumn("power", F.col("a") * F.col("a") + F.col("b") * F.col("b"))
    share = power.withColumn("p", ratio(F.col("power"), F.sum("power").over(Window.partitionBy("container_id")))).filter("p > 0")
    return share.groupBy("container_id").agg((1 + F.sum(F.col("p") * F.log("p")) / F.log(F.lit(float(len(periods))))).alias("omega"))


def mutual_information(panel: DataFrame, metric: str, horizon: int, bins: int = 8) -> DataFrame:
    """Mutual information, in nats, of a value's and a later value's bins of equal count; ties by time."""
    rows = panel.withColumn("later", F.lead(metric, horizon).over(by_time())).dropna(subset=[metric, "later"])
    part = Window.partitionBy("container_id")
    rows = rows.withColumn("a", F.ntile(bins).over(part.orderBy(metric, "time_stamp"))).withColumn("b", F.ntile(bins).over(part.orderBy("later", "time_stamp")))
    cell = rows.groupBy("container_id", "a", "b").agg(F.count("*").alias("n"))
    cell = cell.withColumns({"t": F.sum("n").over(part), "na": F.sum("n").over(Window.partitionBy("container_id", "a")), "nb": F.sum("n").over(Window.partitionBy("container_id", "b"))})
    return cell.groupBy("container_id").agg(F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("na") * F.col("nb")))).alias("mi"))

"""From raw telemetry to a regular, split panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.panel import CPU, MEM, clip

def by_time():
    """Rows of a series in order of time."""
    return Window.partitionBy("container_id").orderBy("time_stamp")



def asof_resample(panel: DataFrame, step_s: int = 300, metrics: tuple[str, ...] = (CPU, MEM), min_raw: int = 10, min_grid: int = 50) -> DataFrame:
    """Each series on a grid from its first to its last time; every metric is its own last value at or before the point.

    One window by series carries the last values forward and tells each raw row the time of the next one; a row then
    yields the grid points from its own time to before the next: no join, one shuffle, one sort. Series with few raw
    rows or grid points are left out.
    """
    rows, first, last = _asof_rows(panel, step_s, metrics, min_raw, min_grid)
    points = rows.select("container_id", "lo", *metrics, F.explode(F.sequence(first, last)).alias("k"))
    return points.select("container_id", (F.col("lo") + F.col("k") * step_s).alias("time_stamp"), *metrics)


def asof_runs(panel: DataFrame, step_s: int = 300, metrics: tuple[str, ...] = (CPU, MEM), min_raw: int = 10, min_grid: int = 50) -> DataFrame:
    """The grid of :func:`asof_resample` without its points: ``container_id, time_stamp``, metrics, ``points``.

    A row is a raw row that grid points see, with its own time and the number of these points, which follow each other;
    in order of time the rows of a series are its whole grid.
    """
    rows, first, last = _asof_rows(panel, step_s, metrics, min_raw, min_grid)
    return rows.select("container_id", "time_stamp", *metrics, (last - first + 1).alias("points"))


def _asof_rows(panel: DataFrame, step_s: int, metrics: tuple[str, ...], min_raw: int, min_grid: int) -> tuple[DataFrame, Column, Column]:
    """Raw rows that grid points see, and the first and last of these points, counted from 0."""
    w = by_time()
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lo, hi, at = F.min("time_stamp").over(whole), F.max("time_stamp").over(whole), F.col("time_stamp")
    sofar = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = panel.select("container_id", "time_stamp", *[F.last(m, ignorenulls=True).over(sofar).alias(m) for m in metrics], lo.alias("lo"), hi.alias("hi"), F.count("*").over(whole).alias("n"), F.lead("time_stamp").over(w).alias("next"))
    rows = rows.filter((F.col("n") >= min_raw) & (F.floor((F.col("hi") - F.col("lo")) / step_s) + 1 >= min_grid))
    first = F.ceil((at - F.col("lo")) / step_s)
    last = F.coalesce(F.ceil((F.col("next") - F.col("lo")) / step_s) - 1, F.floor((F.col("hi") - F.col("lo")) / step_s))
    return rows.filter(first <= last), first, last


def clip_metrics(panel: DataFrame, metrics: tuple[str, ...] = (CPU, MEM)) -> DataFrame:
    return panel.withColumns({m: clip(F.col(m)) for m in metrics})


def temporal_split(panel: DataFrame, cuts: tuple[float, float] = (0.70, 0.85), truncate: bool = False) -> DataFrame:
    """``split`` by the global clock: train before the first cut, val before the second, then test."""
    b = panel.agg(F.min("time_stamp").alias("t0"), F.max("time_stamp").alias("t1"))
    at = [F.col("t0") + c * (F.col("t1") - F.col("t0")) for c in cuts]
    at = [F.floor(c) for c in at] if truncate else at
    b = b.select(at[0].alias("c1"), at[1].alias("c2"))
    return panel.crossJoin(F.broadcast(b)).withColumn("split", F.when(F.col("time_stamp") < F.col("c1"), "train").when(F.col("time_stamp") < F.col("c2"), "val").otherwise("test")).drop("c1", "c2")  # bounds: one row


def split_order_check(split: DataFrame) -> DataFrame:
    """``split, lo, hi, in_order``: whether each split begins after the one before ends."""
    order = F.when(F.col("split") == "train", 0).when(F.col("split") == "val", 1).otherwise(2)
    got = split.groupBy("split").agg(F.min("time_stamp").alias("lo"), F.max("time_stamp").alias("hi"))
    w = Window.orderBy(order)  # three rows
    return got.withColumn("in_order", F.coalesce(F.col("lo") > F.lag("hi").over(w), F.lit(True)))


def split_manifest(split: DataFrame) -> DataFrame:
    return split.groupBy("split").agg(F.count("*").alias("n_rows"), F.countDistinct("container_id").alias("n_series"), F.min("time_stamp").alias("lo"), F.max("time_stamp").alias("hi"))


def grid_regularity(panel: DataFrame) -> DataFrame:
    """Population deviation of the gaps of each series, and whether it is below one second."""
    gaps = panel.withColumn("gap", F.col("time_stamp") - F.lag("time_stamp").over(by_time()))
    return gaps.groupBy("container_id").agg(F.stddev_pop("gap").alias("gap_std")).withColumn("regular", F.coalesce(F.col("gap_std") < 1, F.lit(False)))

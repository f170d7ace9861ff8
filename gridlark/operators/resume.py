"""Results as a table that is filled in step by step: what is there is not computed again."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import materialise

KEYS = ["dataset", "horizon"]
SCHEMA = "stage string, metric string, value double, elapsed_s double, dataset string, horizon int"


def stage_table(spark: SparkSession, path: str) -> DataFrame:
    """The results written so far, see ``SCHEMA``; none where nothing is written yet."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(path)


def run_missing(spark: SparkSession, path: str, tasks: list[tuple[str, int]], compute: Callable[[str, int], DataFrame], again: list[tuple[str, int]] = ()) -> list[tuple[str, int]]:
    """Compute the ``tasks`` (dataset, horizon) that the table at ``path`` lacks, one partition each; those done, in order.

    ``compute`` gives ``stage, metric, value``. A task's partition appears when its job commits, so a run that breaks
    off leaves whole tasks only, and the next one goes on after them. Tasks in ``again`` are computed anyway and
    replace their partition, and no other. ``elapsed_s``: seconds of the task.
    """
    wanted = spark.createDataFrame(list(dict.fromkeys(tasks)), "dataset string, horizon int")
    finished = stage_table(spark, path).select(*KEYS).distinct()
    if again:
        finished = finished.join(spark.createDataFrame(list(again), "dataset string, horizon int"), KEYS, "left_anti")
    todo = [(r.dataset, r.horizon) for r in wanted.join(finished, KEYS, "left_anti").orderBy(*KEYS).collect()]  # a row for each task
    for dataset, horizon in todo:
        began = time.perf_counter()
        rows = materialise(compute(dataset, horizon).select("stage", "metric", F.col("value").cast("double").alias("value")), "stage")
        rows = rows.withColumns({"elapsed_s": F.lit(time.perf_counter() - began), "dataset": F.lit(dataset), "horizon": F.lit(horizon)})
        rows.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*KEYS).parquet(path)
    return todo

"""Queries: the streaming jobs, run over the events table as a stream of everything that is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query
from ..scratch import scratch_path
from ..sources.panel import CPU
from ..streaming.jobs import stream_adaptive_interval, stream_grid_rollup
from .fixtures import rounded


def run_once(stream: DataFrame, schema: str) -> DataFrame:
    """Write all that a stream has now to files in the shared folder, and read them."""
    spark, path = stream.sparkSession, scratch_path(stream.sparkSession, "stream")
    q = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(schema).parquet(f"{path}/out")


def run_updates(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Write what each batch changes of an aggregate to a folder of its own in the shared folder; the last row of each key."""
    spark, path = stream.sparkSession, scratch_path(stream.sparkSession, "stream")
    schema = stream.schema

    def save(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/out/batch={batch}")

    q = stream.writeStream.foreachBatch(save).option("checkpointLocation", f"{path}/checkpoint").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.schema(schema.add("batch", "long")).parquet(f"{path}/out")
    got = rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in stream.columns if c not in keys]), "batch").alias("last"))
    return got.select(*keys, "last.*").select(*stream.columns)


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    e = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    ts = F.col("ts").cast("timestamp")
    return e.select(F.concat(F.lit("c_"), "user_id").alias("container_id"), ts.alias("ts"), F.unix_seconds(ts).alias("time_stamp"), (F.col("value").cast("double") / 5).alias(CPU))


@query("stream_grid_rollup")
def grid_rollup(spark, sf_dir):
    """Buckets of the whole table: open ones come as they stand at the stream's end."""
    return rounded(run_updates(stream_grid_rollup(events_stream(spark, sf_dir)), ["container_id", "time_stamp"]))


@query("stream_adaptive_interval")
def adaptive_interval(spark, sf_dir):
    return rounded(run_once(stream_adaptive_interval(events_stream(spark, sf_dir)), "container_id string, time_stamp long, y_true double, lower double, upper double, miss int"))

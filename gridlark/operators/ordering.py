"""Numbers that follow one order over a whole table, without bringing it to one task."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialise


def running_sum(rows: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` (long, not NULL) over the rows up to this one in ``order``, which must tell rows apart, and ``name_total``, that over all.

    Rows are dealt by ranges of the order and summed range by range; a range's offset is what all ranges before it
    add up to. The driver sees one number for each range. The ranges are written first, so that both passes see the same.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = materialise(rows.withColumn("value*", value.cast("long")).repartitionByRange(parts, *order).withColumn("range*", F.spark_partition_id()), "ordered")
    sums = sorted((r["range*"], r.s) for r in placed.groupBy("range*").agg(F.sum("value*").alias("s")).collect())
    ends = list(accumulate((s for _, s in sums), initial=0))
    offsets = spark.createDataFrame([(k, before, ends[-1]) for (k, _), before in zip(sums, ends, strict=False)], f"`range*` int, `before*` long, `{name}_total` long")
    own = F.sum("value*").over(Window.partitionBy("range*").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return placed.withColumn(name, own).join(F.broadcast(offsets), "range*").withColumn(name, F.col(name) + F.col("before*")).drop("value*", "range*", "before*")


def tile(position: Column, n: Column, tiles: int) -> Column:
    """Tile (from 1) of a row by its position (from 1) among ``n``: sizes differ by one at most, larger ones first."""
    size, more = F.floor(n / tiles), n % tiles
    at, border = position - 1, more * (size + 1)
    return F.when(at < border, F.floor(at / (size + 1)) + 1).otherwise(more + F.floor((at - border) / F.greatest(size, F.lit(1))) + 1).cast("int")

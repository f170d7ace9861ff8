"""Canonical panel: readers and adapters that end in ``container_id, time_stamp, cpu_util_percent, mem_util_percent``.

``time_stamp`` is seconds since 1970; metrics are doubles, NaN is NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CPU, MEM, DISK = "cpu_util_percent", "mem_util_percent", "disk_io_percent"
KEYS = ["container_id", "time_stamp"]

#: Columns of a raw container usage file without a header, in order.
RAW_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("container_id", "machine_id")]
    + [T.StructField("time_stamp", T.LongType())]
    + [T.StructField(c, T.DoubleType()) for c in (CPU, MEM, "cpi", "mem_gps", "mpki", "net_in", "net_out", "disk_io_percent")]
)
#: Columns of a machine's own file, separated by semicolons.
VM_SCHEMA = T.StructType([T.StructField("Timestamp [ms]", T.LongType())] + [T.StructField(c, T.DoubleType()) for c in ("CPU usage [%]", "Memory usage [KB]", "Memory capacity provisioned [KB]")])


def clip(x: Column, low: float = 0.0, high: float = 100.0) -> Column:
    """Bounded value; NULL stays NULL, which greatest and least alone would skip."""
    return F.when(x.isNull(), None).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), x)))


def no_nan(x: Column) -> Column:
    return F.when(F.isnan(x), None).otherwise(x)


def normalise_id(x: Column, prefix: str = "") -> Column:
    """Identifier as text without a trailing ``.0``, with a prefix."""
    return F.concat(F.lit(prefix), F.regexp_replace(F.trim(x.cast("string")), r"\.0$", ""))


def first_present(df: DataFrame, *names: str) -> Column:
    """The first of the named columns that the table has; NULL if it has none."""
    return next((F.col(n) for n in names if n in df.columns), F.lit(None).cast("double"))


def adapt_schema(df: DataFrame, names: dict[str, str], absent: tuple[str, ...] = ()) -> DataFrame:
    """Rename source columns to canonical ones; absent metrics become 0."""
    out = df.withColumnsRenamed(names)
    return out.withColumns({c: F.lit(0.0) for c in absent if c not in out.columns})


def seconds(ts: Column, unit: str) -> Column:
    return F.floor(ts / 1000).cast("long") if unit == "ms" else ts.cast("long")


def detect_epoch_unit(df: DataFrame, ts: str = "time_stamp", by: list[str] | None = None) -> DataFrame:
    """``unit`` of each group's times, by their median: above 1e12 ``ms``, between 9e8 and 2.3e9 ``s``, else ``unknown``."""
    m = F.percentile(ts, F.lit(0.5))
    return df.groupBy(*(by or [])).agg(m.alias("median_ts")).withColumn("unit", F.when(F.col("median_ts") > 1e12, "ms").when((F.col("median_ts") > 9e8) & (F.col("median_ts") < 2.3e9), "s").otherwise("unknown"))


def ingest_headerless_csv(spark: SparkSession, path: str) -> DataFrame:
    """Raw usage rows with an identifier; the schema is fixed, nothing is inferred."""
    return spark.read.schema(RAW_SCHEMA).csv(path).filter("container_id is not null")


def ingest_vm_files(spark: SparkSession, path: str, unit: str = "ms", min_rows: int = 300, prefix: str = "vm_") -> DataFrame:
    """A folder of one file a machine to the canonical panel; the file's name is the machine's identifier.

    Memory is used over provisioned, NULL without capacity; rows with NULLs go, then machines with few rows.
    """
    raw = spark.read.option("sep", ";").option("header", True).option("ignoreLeadingWhiteSpace", True).schema(VM_SCHEMA).csv(path)
    name = F.regexp_replace(F.col("_metadata.file_name"), r"\.csv(\.gz)?$", "")
    raw = raw.select(normalise_id(name, prefix).alias("container_id"), *(F.col(f"`{f.name}`").alias(a) for f, a in zip(VM_SCHEMA, ("ts", "cpu", "used", "cap"), strict=True)))
    return vm_panel(raw, unit, min_rows)


def vm_panel(raw: DataFrame, unit: str = "s", min_rows: int = 300) -> DataFrame:
    """``container_id, ts, cpu, used, cap`` to the canonical panel."""
    share = 100 * F.col("used") / F.nullif("cap", F.lit(0.0))
    rows = raw.select("container_id", seconds(F.col("ts"), unit).alias("time_stamp"), clip(F.col("cpu")).alias(CPU), clip(share).alias(MEM)).dropna()
    many = rows.groupBy("container_id").count().filter(F.col("count") >= min_rows)
    return rows.join(many, "container_id", "left_semi")


def dedup_panel(df: DataFrame, tie: str) -> DataFrame:
    """One row for each series and time: the one with the smallest ``tie``."""
    number = F.row_number().over(Window.partitionBy(*KEYS).orderBy(tie))
    name = next(n for k in range(len(df.columns) + 1) if (n := f"number_{k}") not in {c.lower() for c in df.columns})
    return df.withColumn(name, number).filter(F.col(name) == 1).drop(name)


def hash_part(x: Column, digits: int = 8) -> Column:
    """First hexadecimal digits of md5 as a number: a hash that other engines have too."""
    return F.conv(F.substring(F.md5(x.cast("string").cast("binary")), 1, digits), 16, 10).cast("long")


def bernoulli_sample(df: DataFrame, key: Column, fraction: float = 0.01) -> DataFrame:
    """Rows whose key hashes below the fraction."""
    return df.filter(hash_part(key) < F.lit(int(fraction * 2**32)))


def sample_series(df: DataFrame, n: int) -> DataFrame:
    """All rows of the ``n`` series of least hash."""
    chosen = df.select("container_id").distinct().orderBy(F.md5(F.col("container_id").cast("binary")), "container_id").limit(n)
    return df.join(chosen, "container_id", "left_semi")


def write_panel(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Panel as Parquet with metrics in single precision, partitioned by ``by``; partitions that are there are replaced."""
    small = [F.col(f.name).cast("float").alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema]
    out = df.select(small).write.mode("overwrite").option("compression", "zstd").option("partitionOverwriteMode", "dynamic")
    (out.partitionBy(*by) if by else out).parquet(path)


def read_panel(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Panel from Parquet, or from CSV where a schema is given."""
    return spark.read.schema(schema).option("header", True).csv(path) if schema else spark.read.parquet(path)

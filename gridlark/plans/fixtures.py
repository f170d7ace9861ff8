"""The telemetry panel in the events table, and the SQL fragments that the queries' SQL shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import round_to
from ..operators.forecast import long_forecasts, wide_forecasts
from ..operators.prepare import asof_resample, asof_runs
from ..sources.panel import CPU, DISK, MEM, clip, dedup_panel, no_nan

#: Step of the grid in seconds, points of a day, horizons in steps.
STEP, PER_DAY, HORIZONS = 3600, 24, (1, 2, 6, 12)


def events_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as raw telemetry: a user is a series, the type a machine, a fifth of the value CPU, the property k memory."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(
        F.concat(F.lit("c_"), "user_id").alias("container_id"),
        F.col("event_type").alias("machine_id"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("time_stamp"),
        clip(no_nan(F.col("value").cast("double")) / 5).alias(CPU),
        F.get_json_object("props", "$.k").cast("double").alias(MEM),
        "event_id",
    )


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_panel(events_panel(spark, sf_dir), "event_id")


def by_series(events: DataFrame) -> DataFrame:
    """Rows by series from the start: the deduplication, the resampling and all windows share one shuffle.

    The number of partitions is given, so that it isn't lowered to fit the raw rows: the grid has many times as many.
    """
    return events.repartition(int(events.sparkSession.conf.get("spark.sql.shuffle.partitions")), "container_id")


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asof_resample(dedup_panel(by_series(events_panel(spark, sf_dir)), "event_id"), STEP)


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid as runs of points with the same raw row: a row for each raw row instead of one for each point."""
    return asof_runs(dedup_panel(by_series(events_panel(spark, sf_dir)), "event_id"), STEP)


def disk_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid with a third metric: disk use, made from the event's number."""
    e = events_panel(spark, sf_dir).withColumn(DISK, (F.col("event_id") * 37 % 101).cast("double"))
    return asof_resample(dedup_panel(by_series(e), "event_id"), STEP, (CPU, MEM, DISK))


def wide(spark: SparkSession, sf_dir: str, placed: bool = False) -> DataFrame:
    return wide_forecasts(grid(spark, sf_dir), HORIZONS, PER_DAY, placed)


def long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_forecasts(wide(spark, sf_dir))


def rounded(df: DataFrame, digits: int = 6, other: dict[str, int] | None = None) -> DataFrame:
    """Doubles to a fixed number of digits (``other``: by column), without a negative zero: what the queries return."""
    return df.select([(round_to(F.col(f"`{c}`"), (other or {}).get(c, digits)) + 0.0).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t in ("int", "bigint", "smallint", "tinyint") else F.col(c) for c, t in df.dtypes])


RAW = """raw AS (SELECT 'c_' || user_id AS container_id, event_type AS machine_id, floor(epoch(ts))::BIGINT AS time_stamp,
  greatest(0.0, least(100.0, value::DOUBLE / 5)) AS cpu, json_extract_string(props, '$.k')::DOUBLE AS mem, event_id FROM events)"""
PANEL = RAW + """,
panel AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY container_id, time_stamp ORDER BY event_id) AS n FROM raw) WHERE n = 1)"""
GRID = PANEL + f""",
bounds AS (SELECT container_id, min(time_stamp) AS lo, max(time_stamp) AS hi FROM panel GROUP BY 1 HAVING count(*) >= 10 AND (max(time_stamp) - min(time_stamp)) // {STEP} + 1 >= 50),
points AS (SELECT container_id, unnest(generate_series(lo, hi, {STEP}))::BIGINT AS time_stamp FROM bounds),
grid AS (SELECT g.container_id, g.time_stamp, p.cpu, p.mem FROM points g ASOF LEFT JOIN panel p ON g.container_id = p.container_id AND g.time_stamp >= p.time_stamp)"""
DISK_GRID = GRID.replace("event_id FROM events", "event_id, (event_id * 37 % 101)::DOUBLE AS disk FROM events").replace("p.cpu, p.mem", "p.cpu, p.mem, p.disk")
_W = "PARTITION BY container_id ORDER BY time_stamp"
WIDE = GRID + f""",
moved AS (SELECT container_id, time_stamp, cpu, round(avg(cpu) OVER ({_W} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), 9) AS mean6, round(avg(cpu) OVER ({_W} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW), 9) AS mean24,
  {", ".join(f"lead(cpu, {h}) OVER ({_W}) AS y_{h}, lag(cpu, {PER_DAY - h}) OVER ({_W}) AS s_{h}" for h in HORIZONS)} FROM grid),
wide AS ({" UNION ALL ".join(f"SELECT container_id, time_stamp, {h} AS horizon, y_{h} AS y_true, cpu AS y_naive, cpu AS persistence, s_{h} AS seasonal, mean6, mean24 FROM moved WHERE y_{h} IS NOT NULL AND s_{h} IS NOT NULL AND cpu IS NOT NULL" for h in HORIZONS)})"""
LONG = WIDE + """,
long AS (SELECT container_id, time_stamp, horizon, y_true, y_naive, unnest([{'m': 'persistence', 'p': persistence}, {'m': 'seasonal', 'p': seasonal}, {'m': 'mean6', 'p': mean6}, {'m': 'mean24', 'p': mean24}]) AS f FROM wide),
fc AS (SELECT container_id, time_stamp, horizon, y_true, y_naive, f.m AS model, f.p AS y_pred FROM long)"""


def r(x: str, name: str | None = None, digits: int = 6) -> str:
    """A rounded value of the SQL, as the queries round theirs."""
    return f"round({x}, {digits}) + 0.0" + (f" AS {name}" if name else "")


def _simpson(density: str, to: str, steps: int = 2000) -> str:
    """Integral of a density of ``u`` from 0 to ``to`` in the SQL."""
    at = f"(({to}) * i / {steps}.0)"
    return f"(({to}) / {3 * steps}.0 * list_sum(list_transform(range({steps + 1}), lambda i: (CASE WHEN i IN (0, {steps}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * {density.replace('u', at)})))"


def t_beyond(t: str, df: str) -> str:
    """Two-sided probability of Student's law in the SQL, by quadrature of its density."""
    x = f"least(abs({t}), 40.0)"
    density = f"EXP(lgamma(({df} + 1) / 2.0) - lgamma({df} / 2.0) - 0.5 * LN({df} * pi()) - ({df} + 1) / 2.0 * LN(1 + u * u / {df}))"
    return f"greatest(0, 1 - 2 * {_simpson(density, x)})"


def t_above(t: str, df: str) -> str:
    return f"(CASE WHEN {t} >= 0 THEN {t_beyond(t, df)} / 2 ELSE 1 - {t_beyond(t, df)} / 2 END)"


def chi2_above(x: str, df: int) -> str:
    """Upper tail of the chi-squared law in the SQL, by quadrature over the square root."""
    density = f"(2 * POW(u, {df - 1}) * EXP(-u * u / 2 - {df} / 2.0 * LN(2) - lgamma({df} / 2.0)))"
    return f"greatest(0, 1 - {_simpson(density, f'least(sqrt({x}), 40.0)', 4000)})"


def phi_exact(z: str) -> str:
    """Normal distribution function in the SQL, by its series with double factorials as gamma functions."""
    return f"(CASE WHEN abs({z}) >= 9 THEN (1 + sign({z})) / 2 ELSE 0.5 + sign({z}) * exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(160), lambda k: exp((2 * k + 1) * ln(greatest(abs({z}), 1e-300)) - (k + 1) * ln(2) - lgamma(k + 1.5) + 0.5 * ln(pi())))) END)"


R2 = "1 - sum((y_true - {p}) * (y_true - {p})) / nullif(var_pop(y_true) * count(*), 0)"

"""Leakage-safe features of a series on its grid: nothing looks at a row newer than ``min_lag`` steps ago.

All features of a call come from one window specification, so that Spark plans one shuffle and one sort. What a frame
reads of other rows is worked out in Arrow batches of that sort; what it makes of a row alone are column expressions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import correlation
from ..sources.panel import CPU, DISK, MEM
from .ordering import running_sum
from .prepare import by_time

OFFSETS, WINDOWS, LONGEST = (0, 1, 2, 3, 5, 11, 23, 47), (6, 12, 24, 48), 96
#: Names whose NULLs become 0.
FILLED = ("_std_", "volatility", "_cv", "_range", "accel", "jerk")
METRICS = {"cpu": CPU, "mem": MEM}
#: Of disk use, which not every panel has, only these lags are features.
DISK_OFFSETS = (0, 5, 11)


def lag_names(horizon: int, disk: bool = False) -> dict[str, tuple[str, int]]:
    """Names of the lags, with what they are lags of and by how much."""
    m = horizon + 1
    out = {f"{a}_lag_{m + k}": (c, m + k) for a, c in METRICS.items() for k in OFFSETS if m + k <= LONGEST}
    return out | ({f"disk_lag_{m + k}": (DISK, m + k) for k in DISK_OFFSETS if m + k <= LONGEST} if disk else {})


def lag_features(horizon: int, disk: bool = False) -> dict[str, Column]:
    return {n: F.lag(c, k).over(by_time()) for n, (c, k) in lag_names(horizon, disk).items()}


#: Position of a row in its series (from 1), and what a row reads of others.
_POSITION = "position*"


def _back(a: np.ndarray, k: int, known: np.ndarray, other: float = math.nan) -> np.ndarray:
    """``a`` of ``k`` rows before, ``other`` where the series has none (``known`` tells)."""
    return np.where(known, np.concatenate([np.full(min(k, len(a)), other), a[: max(len(a) - k, 0)]]), other)


def _moments(x: np.ndarray, position: np.ndarray, windows: tuple[int, ...]) -> dict[int, tuple[np.ndarray, ...]]:
    """Number, mean, squared deviations, minimum and maximum of the last rows up to each row, by window; NaN counts as unknown.

    A short block is gone through value by value; windows are merged from blocks, without differences of large sums.
    """
    block, out = math.gcd(*windows), {}
    near = [_back(x, j, position > j) for j in range(block)]
    n = sum((~np.isnan(v)).astype(float) for v in near)
    mean = sum(np.nan_to_num(v) for v in near) / np.maximum(n, 1)
    squares, low, high = sum(np.nan_to_num((v - mean) ** 2) for v in near), reduce(np.fmin, near), reduce(np.fmax, near)
    one = all_ = (n, mean, squares, low, high)
    for w in range(block, max(windows) + 1, block):
        if w > block:
            n, mean, squares, low, high = all_
            m, other, more, lo, hi = (_back(a, w - block, position > w - block, e) for a, e in zip(one, (0.0, 0.0, 0.0, math.nan, math.nan), strict=True))
            share, gap = m / np.maximum(n + m, 1), other - mean
            all_ = n + m, mean + gap * share, squares + more + gap * gap * n * share, np.fmin(low, lo), np.fmax(high, hi)
        if w in windows:
            out[w] = all_
    return out


def rolling_names(windows: tuple[int, ...] = WINDOWS) -> list[str]:
    return [f"{a}_{s}_{w}" for a in METRICS for w in windows for s in ("mean", "std", "min", "max")]


def _rolling(x: np.ndarray, position: np.ndarray, m: int, windows: tuple[int, ...]) -> Iterator[np.ndarray]:
    """Mean, deviation, minimum and maximum over each window that ends ``m`` rows ago, NaN where there is none."""
    for n, mean, squares, low, high in _moments(x, position, windows).values():
        flat = low == high
        spread = np.where((n > 1) & ~flat, np.sqrt(squares / np.maximum(n - 1, 1)), 0.0)
        mean = np.where(n > 0, np.where(flat, low, mean), math.nan)
        yield from (_back(a, m, position > m, e) for a, e in ((mean, math.nan), (spread, 0.0), (low, math.nan), (high, math.nan)))


def with_rolling(panel: DataFrame, horizon: int, lags: dict[str, tuple[str, int]] | None = None, more: dict[str, Column] | None = None, windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """``panel`` with ``lags`` (by name: of what, by how much), ``more`` columns of the same window, and moments over the last rows up to ``min_lag`` ago.

    A window that the series' start cuts short counts with what it has; infinite values count as unknown. Spark sorts the
    series and numbers their rows; a task then reads its rows batch by batch, a column at a time, and keeps the few last
    ones, so that a series of any length passes through and no row is buffered with all that it reads of others.
    """
    m, lags = horizon + 1, lags or {}
    windows = tuple(sorted(windows))
    reach = max([m + max(windows), *(k for _, k in lags.values())])
    rows = panel.withColumns((more or {}) | {_POSITION: F.row_number().over(by_time())})
    kept = [c for c in rows.columns if c != _POSITION]
    needed = list(dict.fromkeys([_POSITION, *METRICS.values(), *(c for c, _ in lags.values())]))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for b in batches:
            if not b.num_rows:
                continue
            now = pa.Table.from_batches([b])
            near = now.select(needed)
            if before is not None:
                near = pa.concat_tables([before, near])
            near, old = near.combine_chunks(), near.num_rows - b.num_rows
            position = near[_POSITION].to_numpy()
            at = np.arange(old, near.num_rows)
            out = [now[c].combine_chunks() for c in kept]
            for c, k in lags.values():
                known = position[old:] > k
                out.append(near[c].take(pa.array(np.where(known, at - k, 0), mask=~known)))
            for c in METRICS.values():
                x = near[c].to_numpy().astype(float)
                x = np.where(np.isfinite(x), x, math.nan)
                out += [pa.array(v[old:], from_pandas=True) for v in _rolling(x, position, m, windows)]
            before = near.slice(max(near.num_rows - reach, 0))
            for part in pa.table(out, names=names).to_batches():
                yield part

    names = [*kept, *lags, *rolling_names(windows)]
    types = dict(rows.dtypes)
    schema = [(c, types[c]) for c in kept] + [(n, types[c]) for n, (c, _) in lags.items()] + [(n, "double") for n in rolling_names(windows)]
    return rows.mapInArrow(add, ", ".join(f"`{c}` {t}" for c, t in schema))


def trend_momentum(horizon: int) -> dict[str, Column]:
    m, out = horizon + 1, {}
    for a in METRICS:
        first = F.col(f"{a}_lag_{m}")
        out |= {f"{a}_trend_short": first - F.col(f"{a}_lag_{m + 1}"), f"{a}_trend_medium": first - F.col(f"{a}_lag_{m + 2}"), f"{a}_trend_long": first - F.col(f"{a}_lag_{m + 47}"), f"{a}_momentum": F.col(f"{a}_mean_6") - F.col(f"{a}_mean_24")}
    return out


def accel_jerk(horizon: int) -> dict[str, Column]:
    """Second and third differences as they stood ``min_lag`` ago; 0 where they are not known."""
    m, out = horizon + 1, {}
    for a in METRICS:
        x = [F.col(f"{a}_lag_{m + k}") for k in range(4)]
        out |= {f"{a}_accel": F.coalesce(x[0] - 2 * x[1] + x[2], F.lit(0.0)), f"{a}_jerk": F.coalesce(x[0] - 3 * x[1] + 3 * x[2] - x[3], F.lit(0.0))}
    return out


def volatility_features() -> dict[str, Column]:
    out = {}
    for a in METRICS:
        std, mean = F.col(f"{a}_std_12"), F.col(f"{a}_mean_12")
        out |= {f"{a}_volatility": F.coalesce(std, F.lit(0.0)), f"{a}_cv": F.coalesce(std / (mean + 1e-6), F.lit(0.0)), f"{a}_range": F.coalesce(F.col(f"{a}_max_12") - F.col(f"{a}_min_12"), F.lit(0.0))}
    return out


def cross_resource_features(horizon: int) -> dict[str, Column]:
    """Joint features; an unknown trend counts as diverging, an unknown value as not saturated."""
    m = horizon + 1
    c, d = F.col(f"cpu_lag_{m}"), F.col(f"mem_lag_{m}")
    a, b = F.col("cpu_trend_short"), F.col("mem_trend_short")
    product = a * b
    return {
        "cpu_mem_ratio": c / (d + 1e-6),
        "cpu_mem_product": c * d / 100,
        "cpu_mem_diff": c - d,
        "saturation": F.coalesce((c > 70) & (d > 70), F.lit(False)).cast("int"),
        "corr_proxy": F.when(product.isNull(), None).otherwise(F.greatest(F.lit(-100.0), F.least(F.lit(100.0), product))),
        "divergence": F.coalesce(F.signum(a) != F.signum(b), F.lit(True)).cast("int"),
    }


def same_time_yesterday(horizon: int) -> dict[str, Column]:
    """Value a day before the newest one allowed (``{metric}_day*``), or else that one; the difference is taken before falling back."""
    m, out = horizon + 1, {}
    for a in METRICS:
        first, day = F.col(f"{a}_lag_{m}"), F.col(f"{a}_day*")
        out |= {f"{a}_same_time_1d": F.coalesce(day, first), f"{a}_diff_1d": F.coalesce(first - day, F.lit(0.0))}
    return out


def cyclic_calendar(ts: str = "time_stamp") -> dict[str, Column]:
    """Hour and weekday of seconds since 1970 (day 0 is that Thursday) and their phases; business hours are 9 to 17, both in."""
    hour = F.pmod(F.col(ts), F.lit(86400)) / 3600.0
    day = F.pmod(F.floor(F.col(ts) / 86400), F.lit(7)).cast("int")
    turn = 2 * math.pi
    return {
        "hour": hour,
        "dow": day,
        "hour_sin": F.sin(hour * (turn / 24)),
        "hour_cos": F.cos(hour * (turn / 24)),
        "dow_sin": F.sin(day * (turn / 7)),
        "dow_cos": F.cos(day * (turn / 7)),
        "business": ((hour >= 9) & (hour <= 17)).cast("int"),
    }


def vm_calendar(ts: str = "time_stamp") -> dict[str, Column]:
    """Calendar hour and weekday (Monday 0); business hours are 8 to before 18 on weekdays."""
    t = F.timestamp_seconds(ts)
    hour, day = F.hour(t) + F.minute(t) / 60.0, F.weekday(t)
    return {"vm_hour": hour, "vm_dow": day, "vm_business": ((hour >= 8) & (hour < 18) & (day < 5)).cast("int")}


def forecast_target(horizon: int) -> dict[str, Column]:
    out = {}
    for a, c in METRICS.items():
        target = F.lead(c, horizon).over(by_time())
        out |= {f"{a}_target": target, f"naive_{a}": F.col(c), f"{a}_residual": target - F.col(c)}
    return out


TARGETS = [f"{a}_{k}" for a in METRICS for k in ("target", "residual")] + [f"naive_{a}" for a in METRICS]


def drop_null_targets(frame: DataFrame) -> DataFrame:
    return frame.dropna(subset=TARGETS)


def feature_frame(panel: DataFrame, horizon: int, per_day: int = 288) -> DataFrame:
    """All features and targets of a panel on its grid, for one horizon in steps; lags of disk use where the panel has it."""
    lags = lag_names(horizon, DISK in panel.columns) | {f"{a}_day*": (c, per_day + horizon + 1) for a, c in METRICS.items()}
    targets = {f"{a}_target": F.lead(c, horizon).over(by_time()) for a, c in METRICS.items()}
    frame = with_rolling(panel, horizon, lags, targets)
    frame = frame.withColumns(accel_jerk(horizon) | same_time_yesterday(horizon) | {f"naive_{a}": F.col(c) for a, c in METRICS.items()} | {f"{a}_residual": F.col(f"{a}_target") - F.col(c) for a, c in METRICS.items()})
    frame = frame.drop(*[f"{a}_day*" for a in METRICS]).withColumns(trend_momentum(horizon) | volatility_features() | cyclic_calendar())
    frame = in_short_methods(frame)  # columns that others are made of are a step of their own
    return in_short_methods(frame.withColumns(cross_resource_features(horizon)))


def in_short_methods(frame: DataFrame) -> DataFrame:
    """``frame``, its expressions and those put upon it compiled in short methods, for tables of many columns.

    Spark would make one method of a row's expressions, too long for the JVM, which then interprets it for every row. A
    higher-order function, here one that changes nothing, has them cut up instead.
    """
    return frame.withColumn("container_id", F.element_at(F.transform(F.array("container_id"), lambda c: c), 1))


def feature_names(horizon: int, disk: bool = False) -> list[str]:
    """Names of the features of :func:`feature_frame`, in order."""
    names = list(lag_names(horizon, disk))
    names += [f"{a}_{s}_{w}" for a in METRICS for w in WINDOWS for s in ("mean", "std", "min", "max")]
    names += [f"{a}_{k}" for a in METRICS for k in ("trend_short", "trend_medium", "trend_long", "momentum", "accel", "jerk", "volatility", "cv", "range", "same_time_1d", "diff_1d")]
    return [*names, "cpu_mem_ratio", "cpu_mem_product", "cpu_mem_diff", "saturation", "corr_proxy", "divergence", "hour", "dow", "hour_sin", "hour_cos", "dow_sin", "dow_cos", "business"]


def feature_sets(names: list[str], horizon: int) -> dict[str, list[str]]:
    """Columns of each learner: ``all`` (forests), ``lags`` and ``rolling`` (two boosted learners that complement each other), ``ablation``.

    ``cluster_id`` is taken where there is one, lags of a metric ``disk`` too; the rolling set has lags up to five steps
    beyond the newest one, and none of ``disk``.
    """
    m = horizon + 1
    lag = {c: int(c.rpartition("_")[2]) for c in names if "_lag_" in c}
    cross = {"cpu_mem_ratio", "cpu_mem_product", "cpu_mem_diff", "corr_proxy", "saturation", "divergence"}
    raw = {"hour", "dow"}
    per = lambda *kinds: {f"{a}_{k}" for a in METRICS for k in kinds}
    daily, change = per("same_time_1d", "diff_1d"), per("trend_short", "trend_medium", "trend_long", "accel", "jerk")
    lags = [c for c in names if lag.get(c, -1) >= m or c in daily | change | {"cluster_id"}]
    near = {c for c, k in lag.items() if m <= k <= m + 5 and c.startswith(tuple(METRICS))}
    everything = [c for c in names if c not in cross | raw and lag.get(c, m) >= m]
    return {"all": everything, "lags": lags, "rolling": [c for c in everything if c in near or c not in set(lag) | change], "ablation": [*everything, *[c for c in names if c in cross]]}


def feature_group(name: Column, horizon: int) -> Column:
    """Group of a feature by its name; the first rule that holds."""
    lag = F.regexp_extract(name, r"_lag_(\d+)$", 1)
    return (
        F.when(lag != "", F.when(F.try_to_number(lag, F.lit("999")).cast("int") <= horizon + 4, "lag_immediate").otherwise("lag_distant"))
        .when(name.rlike("_(mean|min|max)_"), "rolling_level")
        .when(name.rlike("_std_"), "rolling_spread")
        .when(name.rlike("trend|momentum"), "trend")
        .when(name.rlike("accel|jerk"), "difference")
        .when(name.rlike("volatility|_cv|_range"), "volatility")
        .when(name.rlike("_1d$"), "daily")
        .when(name.rlike("^cpu_mem|saturation|corr_proxy|divergence"), "cross_resource")
        .otherwise("calendar")
    )


def vm_features(panel: DataFrame, horizon: int, per_day: int = 288) -> DataFrame:
    """Feature set for single machines: lags 1 to 12, full windows before the row, trends; rows with target and ends of the lags."""
    out = {f"lag_{k}": F.lag(CPU, k).over(by_time()) for k in range(1, 13)}
    for w in (3, 6, 12):
        over = by_time().rowsBetween(-w, -1)
        full = F.count(F.lit(1)).over(over) == w
        out |= {f"mean_{w}": F.when(full, F.avg(CPU).over(over)), f"std_{w}": F.coalesce(F.when(full, F.stddev_samp(CPU).over(over)), F.lit(0.0)), f"max_{w}": F.when(full, F.max(CPU).over(over))}
    out |= {"yesterday": F.coalesce(F.lag(CPU, max(1, per_day - horizon)).over(by_time()), F.lag(CPU, 1).over(by_time())), "target": F.lead(CPU, horizon).over(by_time())}
    frame = panel.withColumns(out)
    frame = frame.withColumns({f"trend_{k}": F.col("lag_1") - F.col(f"lag_{k}") for k in (2, 6, 12)} | {"momentum": F.col("mean_3") - F.col("mean_12")})
    return frame.filter("target is not null and lag_1 is not null and lag_12 is not null")


NEWEST = "newest_row"


def mark_newest(panel: DataFrame) -> DataFrame:
    """``panel`` with ``newest_row``: whether no later row of the series has a current value. From the sort that the features use."""
    whole = by_time().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return panel.withColumn(NEWEST, F.col(CPU).isNotNull() & (F.col("time_stamp") == F.max(F.when(F.col(CPU).isNotNull(), F.col("time_stamp"))).over(whole)))


def latest_feature_row(frame: DataFrame) -> DataFrame:
    """The newest row of each series that has a current value; where the panel was marked by :func:`mark_newest`, other rows go before their features are worked out and sorted."""
    if NEWEST in frame.columns:
        frame = frame.filter(NEWEST).drop(NEWEST)
    newest = F.row_number().over(Window.partitionBy("container_id").orderBy(F.desc("time_stamp")))
    return frame.filter(f"{CPU} is not null").select(F.struct("*").alias("row"), newest.alias("number")).filter("number = 1").select("row.*")


def rolling_origins(panel: DataFrame, horizons: tuple[int, ...], k: int = 20, min_context: int = 24, rule: str = "a") -> DataFrame:
    """``container_id, horizon, origin``: up to ``k`` row positions of each series, evenly spread and rounded half to even.

    Rule ``a`` begins one before the least context and gives one origin where there is room for one; rule ``b``
    begins at the least context and takes the middle for ``k`` = 1.
    """
    n = panel.groupBy("container_id").agg(F.count("*").alias("n")).withColumn("horizon", F.explode(F.array(*map(F.lit, horizons))))
    n = n.withColumn("lo", F.lit(min_context - 1 if rule == "a" else min_context)).withColumn("hi", F.col("n") - F.col("horizon") - 1).filter("hi >= lo")
    if k == 1:
        at = F.col("lo") if rule == "a" else F.bround((F.col("lo") + F.col("hi")) / 2.0)
        return n.select("container_id", "horizon", at.cast("long").alias("origin"))
    n = n.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return n.select("container_id", "horizon", F.bround(F.col("lo") + F.col("i") * (F.col("hi") - F.col("lo")) / float(k - 1)).cast("long").alias("origin")).distinct()


def mark_origins(panel: DataFrame, horizons: tuple[int, ...], ks: tuple[int, ...], min_context: int = 24) -> DataFrame:
    """``panel`` with ``origins_k`` for each of ``ks`` (2 or more): a bit for each horizon that a row is one of the :func:`rolling_origins` (rule ``a``) of; from the sort that windows by time use, without a join.

    Where there are fewer rows than ``k`` all are origins; else a row can only be that of the number next to where it lies.
    """
    whole = by_time().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = panel.withColumns({"place*": F.row_number().over(by_time()) - 1, "rows*": F.count("*").over(whole)})
    lo, p = min_context - 1, F.col("place*")

    def hit(h: int, k: int) -> Column:
        hi = F.col("rows*") - h - 1
        span = F.greatest(hi - lo, F.lit(1))
        number = F.rint((p - lo) * float(k - 1) / span)
        return (p >= lo) & (p <= hi) & ((hi - lo < k - 1) | (F.rint(lo + number * span / float(k - 1)) == p))

    bits = {f"origins_{k}": sum((F.when(hit(h, k), 2**i).otherwise(0) for i, h in enumerate(horizons)), F.lit(0)) for k in ks}
    return rows.withColumns(bits).drop("place*", "rows*")


def strided_origins(panel: DataFrame, horizon: int, stride: int = 3, context: int = 128) -> DataFrame:
    """Every ``stride``-th position with a target, with the size and mean of the context before it."""
    over = by_time().rowsBetween(-(context - 1), 0)
    rows = panel.withColumns({"pos": F.row_number().over(by_time()) - 1, "target": F.lead(CPU, horizon).over(by_time()), "n_context": F.count(CPU).over(over), "context_mean": F.avg(CPU).over(over)})
    return rows.filter((F.col("pos") >= 1) & (F.pmod(F.col("pos") - 1, F.lit(stride)) == 0) & F.col("target").isNotNull() & (F.col("n_context") >= 3))


def lookback_windows(panel: DataFrame, length: int = 12, stride: int = 1) -> DataFrame:
    """``values``: the last ``length`` values up to each row, where there are as many; windows never cross series."""
    rows = panel.withColumns({"pos": F.row_number().over(by_time()) - 1, "values": F.collect_list(CPU).over(by_time().rowsBetween(-(length - 1), 0))})
    return rows.filter((F.size("values") == length) & (F.pmod(F.col("pos"), F.lit(stride)) == 0)).select("container_id", "time_stamp", "values")


def time_folds(panel: DataFrame, folds: int = 5) -> DataFrame:
    """``fold``: 0 for the first block of time, then 1 to ``folds``; blocks are equal shares of the global time range."""
    b = panel.agg(F.min("time_stamp").alias("t0"), F.max("time_stamp").alias("t1"))
    fold = F.least(F.floor((F.col("time_stamp") - F.col("t0")) * (folds + 1) / F.greatest(F.col("t1") - F.col("t0"), F.lit(1))), F.lit(folds))
    return panel.crossJoin(F.broadcast(b)).withColumn("fold", fold.cast("int")).drop("t0", "t1")  # bounds: one row


def series_arrays(panel: DataFrame) -> DataFrame:
    """Values of each series in order of time."""
    pairs = F.array_sort(F.collect_list(F.struct("time_stamp", CPU)))
    return panel.groupBy("container_id").agg(pairs.alias("pairs")).select("container_id", F.transform("pairs", lambda p: p[CPU]).alias("values"))


def container_index(panel: DataFrame) -> DataFrame:
    """Where each series begins and ends when series are laid out by name."""
    n = panel.groupBy("container_id").agg(F.count("*").alias("n_points"))
    ends = running_sum(n, ["container_id"], F.col("n_points"), "end_idx").drop("end_idx_total")
    return ends.withColumn("start_idx", F.col("end_idx") - F.col("n_points"))


def mase_denominator(panel: DataFrame, per_day: int) -> DataFrame:
    """Mean absolute change from a day before, and why a series has none."""
    rows = panel.withColumn("change", F.abs(F.col(CPU) - F.lag(CPU, per_day).over(by_time())))
    got = rows.groupBy("container_id").agg(F.count("*").alias("n"), F.count(CPU).alias("known"), F.avg("change").alias("d"))
    reason = F.when(F.col("known") < F.col("n"), "null").when(F.col("n") <= per_day, "short").when(F.col("d") < 1e-10, "constant").otherwise("ok")
    return got.withColumn("reason", reason).select("container_id", F.when(F.col("reason") == "ok", F.col("d")).alias("denominator"), "reason")


def acf(panel: DataFrame, lags: tuple[int, ...]) -> DataFrame:
    """Correlation of each series with itself ``k`` steps on, with the means of the two parts."""
    rows = panel.withColumns({f"x{k}": F.lag(CPU, k).over(by_time()) for k in lags})
    return rows.groupBy("container_id").agg(*[correlation(F.col(f"x{k}"), F.col(CPU)).alias(f"acf_{k}") for k in lags])

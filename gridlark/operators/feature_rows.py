"""Feature rows for learners, handed to a function batch by batch: of a panel, whose features a task works out as it goes and no table holds, or of a written frame."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialise
from ..sources.panel import CPU, MEM
from . import features as ft
from .prepare import by_time

#: Rows that are worked on together.
BATCH = 16_384


@dataclass
class Batch:
    """Rows with targets: key, time, target, naive value, residual, and the cleaned features as a matrix."""

    container_id: pa.Array
    time_stamp: np.ndarray
    target: np.ndarray
    naive: np.ndarray
    residual: np.ndarray
    x: np.ndarray

    def __len__(self) -> int:
        return len(self.time_stamp)


Work = Callable[[Iterator[Batch]], Iterator[pa.RecordBatch]]


class PanelRows:
    """The rows of :func:`features.feature_frame` of a panel on its grid that have targets, features cleaned (unknown and infinite ones 0)."""

    def __init__(self, panel: DataFrame, horizon: int, per_day: int = 288):
        self.spark, self.horizon, self.per_day = panel.sparkSession, horizon, per_day
        targets = {f"{a}*": F.lead(c, horizon).over(by_time()).cast("double") for a, c in ft.METRICS.items()}
        values = panel.select("container_id", F.col("time_stamp").cast("long").alias("time_stamp"), F.col(CPU).cast("double").alias(CPU), F.col(MEM).cast("double").alias(MEM))
        self.rows = values.withColumns(targets | {"position*": F.row_number().over(by_time())})
        self._times = None

    def times(self) -> DataFrame:
        """``time_stamp, n``: the distinct times of the rows and how many there are of each, written once; bounds of splits and folds come from them."""
        if self._times is None:
            known = self.rows.dropna(subset=[CPU, MEM, "cpu*", "mem*"]).withColumns({f"{a}-": F.col(f"{a}*") - F.col(c) for a, c in ft.METRICS.items()}).dropna(subset=["cpu-", "mem-"])
            self._times = materialise(known.groupBy("time_stamp").agg(F.count("*").alias("n")), "times")
        return self._times

    def map(self, work: Work, schema: str, features: list[str], lo: float = -math.inf, hi: float = math.inf) -> DataFrame:
        """``work`` over the rows of each task from time ``lo`` to before ``hi``."""
        horizon, per_day, size = self.horizon, self.per_day, BATCH
        reach = max(ft.LONGEST, per_day, max(ft.WINDOWS)) + horizon + 1

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return work(_panel_batches(batches, features, horizon, per_day, reach, lo, hi, size))

        return self.rows.mapInArrow(run, schema)


class FrameRows:
    """The same of a frame with features and targets, which is written first."""

    def __init__(self, frame: DataFrame, table: DataFrame):
        self.spark, self.table = frame.sparkSession, table

    def times(self) -> DataFrame:
        return self.table.groupBy("time_stamp").agg(F.count("*").alias("n"))

    def map(self, work: Work, schema: str, features: list[str], lo: float = -math.inf, hi: float = math.inf) -> DataFrame:
        keys = ["container_id", "time_stamp", "cpu_target", "naive_cpu", "cpu_residual"]

        def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[Batch]:
            for b in parts:
                if b.num_rows:
                    col = lambda c: b[c].to_numpy(zero_copy_only=False)  # noqa: B023, E731
                    yield Batch(b["container_id"], *map(col, keys[1:]), np.array([col(f) for f in features]).reshape(len(features), b.num_rows).T)

        rows = self.table.filter((F.col("time_stamp") >= lo) & (F.col("time_stamp") < hi)).select(*keys, *features)
        return rows.mapInArrow(lambda parts: work(batches(parts)), schema)


def _panel_batches(batches: Iterator[pa.RecordBatch], features: list[str], horizon: int, per_day: int, reach: int, lo: float, hi: float, size: int) -> Iterator[Batch]:
    """Rows with targets and their features from the sorted rows of a task, whose last ones are kept over batch borders."""
    before = None
    for b in batches:
        for start in range(0, b.num_rows, size):
            now = pa.Table.from_batches([b.slice(start, size)])
            near = now if before is None else pa.concat_tables([before, now])
            old, near = near.num_rows - now.num_rows, near.combine_chunks()
            before = near.slice(max(near.num_rows - reach, 0))
            time = near["time_stamp"].to_numpy()
            value = {c: near[c].to_numpy() for c in (CPU, MEM, "cpu*", "mem*")}
            with np.errstate(all="ignore"):
                residual = {a: value[f"{a}*"] - value[c] for a, c in ft.METRICS.items()}
            unknown = np.isnan(value[CPU]) | np.isnan(value[MEM]) | np.isnan(residual["cpu"]) | np.isnan(residual["mem"])
            wanted = ~unknown & (time >= lo) & (time < hi)
            wanted[:old] = False
            if not wanted.any():
                continue
            seen = np.zeros(near.num_rows + 1, int)  # rows that a wanted one looks at
            np.add.at(seen, np.maximum(np.flatnonzero(wanted) - reach, 0), 1)
            np.add.at(seen, np.flatnonzero(wanted) + 1, -1)
            kept = seen.cumsum()[:-1] > 0
            at = np.flatnonzero(wanted[kept])
            null = {c: near[c].is_null().to_numpy()[kept] for c in (CPU, MEM)}
            with np.errstate(all="ignore"):
                got = feature_arrays({c: value[c][kept] for c in (CPU, MEM)}, null, near["position*"].to_numpy()[kept], time[kept], at, set(features), horizon, per_day)
                x = np.array([got[f] for f in features]).reshape(len(features), len(at)).T
            x[~np.isfinite(x)] = 0.0
            yield Batch(near["container_id"].combine_chunks().filter(pa.array(wanted)), time[wanted], value["cpu*"][wanted], value[CPU][wanted], residual["cpu"][wanted], x)


def feature_arrays(value: dict[str, np.ndarray], null: dict[str, np.ndarray], position: np.ndarray, time: np.ndarray, at: np.ndarray, wanted: set[str], horizon: int, per_day: int) -> dict[str, np.ndarray]:
    """The columns of :func:`features.feature_frame` at the rows ``at`` of a sorted stretch, NaN where not known; ``null`` tells NULL from NaN, where that matters."""
    m, out, row = horizon + 1, {}, position[at]

    def lag(c: str, k: int) -> tuple[np.ndarray, np.ndarray]:
        known, source = row > k, np.maximum(at - k, 0)
        return np.where(known, value[c][source], math.nan), ~known | null[c][source]

    lags, nulls = {}, {}
    for n, (c, k) in ft.lag_names(horizon).items():
        lags[n], nulls[n] = lag(c, k)
    out |= lags
    for a, c in ft.METRICS.items():
        x = np.where(np.isfinite(value[c]), value[c], math.nan)
        moments = (v[at] for v in ft._rolling(x, position, m, tuple(sorted(ft.WINDOWS))))
        out |= dict(zip((f"{a}_{s}_{w}" for w in sorted(ft.WINDOWS) for s in ("mean", "std", "min", "max")), moments, strict=True))
        first, step = lags[f"{a}_lag_{m}"], [lags[f"{a}_lag_{m + k}"] for k in range(4)]
        day, no_day = lag(c, per_day + m)
        out |= {f"{a}_trend_short": first - step[1], f"{a}_trend_medium": first - step[2], f"{a}_trend_long": first - lags[f"{a}_lag_{m + 47}"], f"{a}_momentum": out[f"{a}_mean_6"] - out[f"{a}_mean_24"]}
        out |= {f"{a}_accel": step[0] - 2 * step[1] + step[2], f"{a}_jerk": step[0] - 3 * step[1] + 3 * step[2] - step[3]}
        out |= {f"{a}_volatility": out[f"{a}_std_12"], f"{a}_cv": out[f"{a}_std_12"] / (out[f"{a}_mean_12"] + 1e-6), f"{a}_range": out[f"{a}_max_12"] - out[f"{a}_min_12"]}
        out |= {f"{a}_same_time_1d": np.where(no_day, first, day), f"{a}_diff_1d": first - day}
    if wanted & {"cpu_mem_ratio", "cpu_mem_product", "cpu_mem_diff", "saturation", "corr_proxy", "divergence"}:
        c, d, a, b = lags[f"cpu_lag_{m}"], lags[f"mem_lag_{m}"], out["cpu_trend_short"], out["mem_trend_short"]
        high = [~nulls[f"{n}_lag_{m}"] & ~(v <= 70) for n, v in (("cpu", c), ("mem", d))]  # NaN counts as large, as in SQL
        no = [nulls[f"{n}_lag_{m}"] | nulls[f"{n}_lag_{m + 1}"] for n in ("cpu", "mem")]
        product, sa, sb = a * b, np.sign(a), np.sign(b)
        out |= {"cpu_mem_ratio": c / (d + 1e-6), "cpu_mem_product": c * d / 100, "cpu_mem_diff": c - d, "saturation": (high[0] & high[1]).astype(float)}
        out["corr_proxy"] = np.where(no[0] | no[1], math.nan, np.where(np.isnan(product), 100.0, np.clip(product, -100.0, 100.0)))
        out["divergence"] = (no[0] | no[1] | ~((sa == sb) | (np.isnan(sa) & np.isnan(sb)))).astype(float)
    t, turn = time[at], 2 * math.pi
    hour, day = t % 86400 / 3600.0, (t // 86400 % 7).astype(float)
    return out | {"hour": hour, "dow": day, "hour_sin": np.sin(hour * (turn / 24)), "hour_cos": np.cos(hour * (turn / 24)), "dow_sin": np.sin(day * (turn / 7)), "dow_cos": np.cos(day * (turn / 7)), "business": ((hour >= 9) & (hour <= 17)).astype(float)}

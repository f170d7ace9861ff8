"""Structured Streaming jobs over telemetry."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.intervals import quantile
from ..sources.panel import CPU


def stream_grid_rollup(stream: DataFrame, step: str = "5 minutes", late: str = "1 hour") -> DataFrame:
    """Last value of each series in each bucket of event time ``ts``; rows later than the watermark are dropped."""
    rows = stream.withWatermark("ts", late)
    got = rows.groupBy(F.window("ts", step), "container_id").agg(F.max_by(CPU, "ts").alias(CPU), F.count("*").alias("n"))
    return got.select("container_id", F.unix_seconds("window.start").alias("time_stamp"), CPU, "n")


def stream_adaptive_interval(stream: DataFrame, gamma: float = 0.05, alpha: float = 0.2, buffer: int = 2000) -> DataFrame:
    """Adaptive interval of each series' next value by persistence; alpha and the last residuals are the series' state.

    Rows of a series must come in order of time within a micro-batch or over them; the batch is sorted.
    """
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        a, last, errors = state.get if state.exists else (alpha, None, [])
        errors = list(errors)
        ordered = sorted(errors)
        rows = pd.concat(list(batches)).sort_values("time_stamp")
        out = []
        for t, y in zip(rows.time_stamp, rows[CPU], strict=True):
            if last is not None:
                e = abs(y - last)
                if errors:
                    q = quantile(ordered, 1 - a)
                    miss = int(e > q)
                    out.append((key[0], int(t), float(y), last - q, last + q, miss))
                    a = min(0.99, max(0.01, a + gamma * (alpha - miss)))
                insort(ordered, e)
                errors.append(e)
                if len(errors) > buffer:
                    del ordered[bisect_left(ordered, errors.pop(0))]
            last = float(y)
        state.update((a, last, errors))
        yield pd.DataFrame(out, columns=["container_id", "time_stamp", "y_true", "lower", "upper", "miss"])

    schema = "container_id string, time_stamp long, y_true double, lower double, upper double, miss int"
    return stream.groupBy("container_id").applyInPandasWithState(step, schema, "a double, last double, errors array<double>", "append", GroupStateTimeout.NoTimeout)

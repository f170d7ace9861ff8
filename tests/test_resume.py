"""Results filled in by several runs: only what is missing is computed; a task's partition is replaced alone."""

import pytest
from pyspark.sql import functions as F

from gridlark.operators import intervals, resume

import numpy as np


def test_second_run_computes_only_what_is_missing(spark, tmp_path):
    path, calls = f"file://{tmp_path}/stages", []

    def compute(dataset, horizon):
        calls.append((dataset, horizon))
        return spark.createDataFrame([("naive", "mae", horizon + 0.5), ("naive", "r2", None)], "stage string, metric string, value double")

    assert resume.run_missing(spark, path, [("b", 1), ("a", 2)], compute) == [("a", 2), ("b", 1)]
    first = {(r.dataset, r.horizon): r.elapsed_s for r in resume.stage_table(spark, path).collect()}
    assert resume.run_missing(spark, path, [("a", 2), ("a", 6), ("b", 1), ("a", 6)], compute) == [("a", 6)]
    assert calls == [("a", 2), ("b", 1), ("a", 6)]
    assert resume.run_missing(spark, path, [("a", 2), ("b", 1)], compute, again=[("b", 1)]) == [("b", 1)]
    got = resume.stage_table(spark, path).collect()
    assert sorted((r.dataset, r.horizon, r.metric, r.value) for r in got) == sorted((d, h, m, v) for d, h in (("a", 2), ("a", 6), ("b", 1)) for m, v in (("mae", h + 0.5), ("r2", None)))
    assert all(r.elapsed_s == first["a", 2] for r in got if (r.dataset, r.horizon) == ("a", 2)) and all(r.elapsed_s > 0 for r in got)
    assert resume.run_missing(spark, path, [("a", 2)], compute) == []


def test_a_task_that_fails_leaves_no_partition(spark, tmp_path):
    path = f"file://{tmp_path}/stages"

    def broken(dataset, horizon):
        return spark.range(1).select(F.lit("s").alias("stage"), F.lit("m").alias("metric"), F.raise_error(F.lit("no")).cast("double").alias("value"))

    with pytest.raises(Exception, match="no"):
        resume.run_missing(spark, path, [("a", 1)], broken)
    assert resume.stage_table(spark, path).count() == 0


def test_series_longer_than_a_batch(spark):
    """Batches of ten rows: state goes over their borders, for intervals and for the bounds of all step sizes."""
    rng = np.random.default_rng(7)
    series = {("m", f"s{k}"): (rng.normal(size=n), rng.normal(size=n)) for k, n in enumerate((1, 2, 9, 10, 11, 95))}
    rows = [(2, m, c, t, float(y[t]), float(p[t])) for (m, c), (y, p) in series.items() for t in rng.permutation(len(y)).tolist()]
    df = spark.createDataFrame(rows, "horizon int, model string, container_id string, time_stamp long, y_true double, y_pred double")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        got = {(r.model, r.container_id, r.gamma): r for r in intervals.adaptive_conformal(df, (0.01, 0.1), buffer=7).collect()}
        bounds = intervals.expert_bounds(df, (0.1, 0.01), buffer=7).toPandas()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for (m, c), (y, p) in series.items():
        halves, missed = [], []
        for g in (0.1, 0.01):
            n, misses, width, a = intervals.adaptive_fold(y, p, g, buffer=7, warm=len(y) // 2)
            if n:
                r = got[m, c, g]
                assert (r.n, r.coverage, r.width, r.last_alpha) == pytest.approx((n, 1 - misses / n, width / n, a))
                steps = list(intervals.adaptive_steps(np.abs(y - p).tolist(), g, 0.2, 7, len(y) // 2))
                halves.append([q for _, q, _, _ in steps])
                missed.append(misses / n)
            else:
                assert (m, c, g) not in got
        own = bounds[bounds.container_id == c].sort_values("time_stamp")
        if halves:
            w = np.exp(-10 * np.array(missed))
            half = w @ np.array(halves) / w.sum()
            assert np.allclose(own.upper - p[own.time_stamp], half) and np.allclose(p[own.time_stamp] - own.lower, half)
        else:
            assert own.empty

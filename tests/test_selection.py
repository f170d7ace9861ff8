"""Percentiles by refined parts, running sums by ranges: against NumPy and plain loops, small limits so that all paths run."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlark.operators import evaluate as ev
from gridlark.operators import ordering, selection


def test_percentiles(spark):
    g = np.random.default_rng(2)
    groups = {
        "even": g.random(900),
        "tied": np.repeat([1.0, 2.0, 2.5], [400, 1, 400]),
        "steep": np.concatenate([10.0 ** g.uniform(-300, 300, 500), -(10.0 ** g.uniform(-5, 5, 500))]),
        "near": 1 + np.arange(700) * 2.0**-50,
        "one": np.array([7.5]),
        None: g.normal(size=333),
    }
    rows = [(k, float(x)) for k, v in groups.items() for x in v] + [("even", None), ("empty", None), ("near", float("nan"))]
    levels = (0.0, 0.25, 0.5, 0.95, 1.0)
    df = spark.createDataFrame(rows, "k string, x double")
    got = {(r.k, r.level): r.percentile for r in selection.exact_percentiles(df, ["k"], "x", levels, parts=4, direct=40).collect()}
    assert set(got) == {(k, p) for k in groups for p in levels}
    for k, v in groups.items():
        assert [got[k, p] for p in levels] == pytest.approx(np.quantile(v, levels).tolist(), rel=1e-12, abs=1e-300), k
    whole = selection.exact_percentiles(df.filter("k = 'even'"), [], "x", (0.5,)).first()
    assert whole.percentile == pytest.approx(float(np.median(groups["even"])))
    assert selection.exact_percentiles(df.limit(0), ["k"], "x", (0.5,)).count() == 0


def test_running_sum(spark):
    rows = [(f"k{i * 37 % 211:03d}", i % 5) for i in range(211)]
    got = ordering.running_sum(spark.createDataFrame(rows, "k string, n int"), ["k"], F.col("n"), "upto").collect()
    total = 0
    for k, n in sorted(rows):
        total += n
        assert next(r for r in got if r.k == k).upto == total
    assert {r.upto_total for r in got} == {sum(n for _, n in rows)}
    assert ordering.running_sum(spark.createDataFrame([], "k string, n int"), ["k"], F.col("n"), "upto").count() == 0


@pytest.mark.parametrize("n", [1, 3, 4, 10, 11, 40])
def test_tiles_are_ntile(spark, n):
    df = spark.range(1, n + 1).select("id", ordering.tile(F.col("id"), F.lit(n), 4).alias("a"), F.expr("ntile(4) over (order by id)").alias("b"))
    assert df.filter("a <> b").count() == 0


def test_no_task_sorts_all_series(spark):
    """The plans of quartiles and of the index have no exchange to a single partition under a window."""
    from gridlark.operators import features as ft

    panel = spark.createDataFrame([(f"c{i % 9}", i, float(i * i % 17)) for i in range(180)], "container_id string, time_stamp long, cpu_util_percent double")
    long = panel.select("container_id", "time_stamp", F.lit(1).alias("horizon"), F.lit("m").alias("model"), F.col("cpu_util_percent").alias("y_true"), F.lit(3.0).alias("y_naive"), F.lit(4.0).alias("y_pred"))
    acfs = panel.groupBy("container_id").agg(F.avg("cpu_util_percent").alias("acf"))
    for df in (ft.container_index(panel), ev.quartile_skill(long, acfs)):
        assert "SinglePartition" not in df._jdf.queryExecution().executedPlan().toString()
        assert df.count() > 0

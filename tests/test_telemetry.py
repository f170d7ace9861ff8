"""Hand-made frames for the telemetry operators."""

import math

import numpy as np
import pytest
from gridlark.operators import evaluate, features, forecast, intervals, prepare, profile
from gridlark.sources import panel as src
from gridlark.sources.panel import CPU, MEM
from pyspark.sql import functions as F

SCHEMA = f"container_id string, time_stamp long, {CPU} double, {MEM} double"


def series(values, step=300, mem=None, name="a"):
    return [(name, i * step, v, (mem or values)[i]) for i, v in enumerate(values)]


def rows(df, order="time_stamp"):
    return df.orderBy(order).collect()


def test_asof_takes_the_last_known_value(spark):
    raw = [("a", 0, 1.0, None), ("a", 290, 2.0, 5.0), ("a", 600, 3.0, None), ("a", 1500, 4.0, 7.0)]
    got = rows(prepare.asof_resample(spark.createDataFrame(raw, SCHEMA), 300, min_raw=2, min_grid=2))
    assert [(r.time_stamp, r[CPU], r[MEM]) for r in got] == [(0, 1, None), (300, 2, 5), (600, 3, 5), (900, 3, 5), (1200, 3, 5), (1500, 4, 7)]
    assert prepare.asof_resample(spark.createDataFrame(raw, SCHEMA), 300, min_raw=5, min_grid=2).count() == 0


def test_lags_trends_and_differences_of_a_line(spark):
    frame = features.feature_frame(spark.createDataFrame(series([float(i) for i in range(120)]), SCHEMA), 2, 24)
    last = rows(frame)[-1]
    assert last.cpu_lag_3 == 116 and last.cpu_mean_6 == np.mean(range(111, 117)) and last.cpu_max_48 == 116
    assert (last.cpu_accel, last.cpu_jerk, last.cpu_trend_short, last.cpu_trend_long) == (0, 0, 1, 47)
    assert last.cpu_same_time_1d == 119 - 27 and last.cpu_diff_1d == 24 and last.cpu_target is None


def test_no_feature_looks_past_the_guard(spark):
    a = [float((i * 37) % 101) for i in range(90)]
    b = a[:60] + [v + 50 for v in a[60:]]
    at = 61  # sees rows up to 58 with a horizon of 2
    names = [n for n in features.feature_names(2) if n not in ("hour", "dow")]
    x, y = (rows(features.feature_frame(spark.createDataFrame(series(v), SCHEMA), 2, 24))[at] for v in (a, b))
    assert all(x[n] == y[n] for n in names)


def test_unknown_trends_diverge_and_are_not_saturated(spark):
    first = rows(features.feature_frame(spark.createDataFrame(series([90.0] * 60), SCHEMA), 2, 24))[0]
    assert (first.divergence, first.saturation) == (1, 0)


def test_constant_series_give_null_not_errors(spark):
    p = spark.createDataFrame(series([5.0] * 60), SCHEMA)
    w = forecast.wide_forecasts(p, (1,), 24)
    r = evaluate.series_r2(forecast.long_forecasts(w)).first()
    assert r.r2_model is None and r.note == "constant_y_true"
    assert profile.vm_scan(p).first().acf1 is None and profile.cpu_mem_correlation(p).first().corr is None


def test_origins_round_half_to_even(spark):
    p = spark.createDataFrame(series([1.0] * 30), SCHEMA)
    got = sorted(r.origin for r in features.rolling_origins(p, (2,), k=10, min_context=24).collect())
    want = sorted({int(np.round(x)) for x in np.linspace(23, 27, 10)})
    assert got == want
    assert features.rolling_origins(p, (7,), k=10, min_context=24).count() == 0


def test_interval_mode_takes_the_smallest_of_equals(spark):
    t = [0, 100, 200, 260, 320]
    r = profile.interval_regularity(spark.createDataFrame([("a", x, 1.0, 1.0) for x in t], SCHEMA)).first()
    assert r.mode_s == 60 and r.regular_pct == 50 and r.grade == "POOR"


def test_nnls_against_projected_gradient():
    rng = np.random.default_rng(0)
    for _ in range(20):
        x, y = rng.normal(size=(60, 4)), rng.normal(size=60)
        w = np.zeros(4)
        g, b = x.T @ x, x.T @ y
        for _ in range(20_000):
            w = np.maximum(0, w - (g @ w - b) / np.linalg.norm(g, 2))
        assert np.allclose(forecast.nnls(g, b), w, atol=1e-6)
    x = np.ones((10, 2))
    assert forecast.nnls(x.T @ x, x.T @ np.ones(10)).sum() == pytest.approx(1)
    assert (forecast.nnls(np.eye(2), np.array([-1.0, -2.0])) == 0).all()


def test_combination_weights_add_up(spark):
    v = [50 + 20 * math.sin(i / 4) + (i * 7 % 5) for i in range(200)]
    w = forecast.wide_forecasts(spark.createDataFrame(series(v), SCHEMA), (1, 2), 24)
    weights = forecast.nnls_weights(w, ("seasonal", "mean6", "mean24"), ["horizon"], leave_out=True)
    for r in weights.groupBy("horizon", "left_out").agg(F.sum("weight").alias("s"), F.min("weight").alias("m")).collect():
        assert r.s == pytest.approx(1) and r.m >= 0
    assert forecast.apply_weights(forecast.long_forecasts(w), weights, ["horizon"]).count() == 4 * w.count()


def test_adaptive_fold_against_a_plain_loop():
    rng = np.random.default_rng(1)
    y, p = rng.normal(size=80), np.zeros(80)
    a, buf, n, misses, width = 0.2, [], 0, 0, 0.0
    for e in np.abs(y - p):
        if buf:
            q = np.quantile(buf, 1 - a)
            n, misses, width = n + 1, misses + (e > q), width + 2 * q
            a = min(0.99, max(0.01, a + 0.05 * (0.2 - (e > q))))
        buf = (buf + [e])[-5:]
    assert intervals.adaptive_fold(y, p, 0.05, buffer=5) == pytest.approx((n, misses, width, a))
    late = intervals.adaptive_fold(y, p, 0.05, buffer=5, warm=30)
    assert late[0] == 50 and late == pytest.approx(intervals.adaptive_fold(y[25:], p[25:], 0.05, buffer=5, warm=5))


def test_scaling_policy_by_hand(spark):
    """Demands .5, .2, .9 after .5, .5, .2: at target .5 and margin 1 the rule gives ceil(seen / .25) replicas of .5, so capacities 1, 1, .5."""
    p = spark.createDataFrame([("a", i, v, 0.0) for i, v in enumerate((50.0, 50.0, 20.0, 90.0))], SCHEMA)
    r = evaluate.scaling_policy_sweep(p, CPU, (0.5,), (1.0,), (1,)).first()
    assert (r.violation, r.waste, r.severity) == pytest.approx((1 / 3, (0.5 + 0.8) / 2.5, 0.4 / 1.6))
    assert r.cost_per_hour == pytest.approx(0.05 * r.waste + 0.5 * r.violation)


def test_dm_statistics_by_hand(spark):
    """Absolute errors 1 and 2 by turns against 3: d is -2, -1, ..., mean -1.5, variance .25; with one step the factor is sqrt((n - 1) / n)."""
    n = 40
    data = [("a", i, 1, 0.0, 3.0, 1.0 + i % 2, 3.0) for i in range(n)]
    w = spark.createDataFrame(data, "container_id string, time_stamp long, horizon int, y_true double, y_naive double, one double, two double")
    r = evaluate.dm_matrix(w, ["one", "two"]).first()
    assert r.dm == pytest.approx(-1.5 / math.sqrt(0.25 / n) * math.sqrt((n - 1) / n))
    d = [(1.0 + i % 2) ** 2 - 9 for i in range(n)]
    mean = sum(d) / n
    c = [x - mean for x in d]
    v = sum(x * x for x in c) / n + 2 * sum(a * b for a, b in zip(c, c[1:], strict=False)) / (n - 1)
    long = w.select("container_id", "time_stamp", "horizon", "y_true", "y_naive", F.lit("one").alias("model"), F.col("one").alias("y_pred"))
    got = evaluate.dm_test(long, 1).first()
    assert got.dm == pytest.approx(mean / math.sqrt(max(v / n, 1e-12)) * math.sqrt((n - 1) / n)) and got.note is None
    assert got.p_one == pytest.approx(0, abs=1e-6) and evaluate.dm_test(long.limit(2), 1).first().note == "too_few_points"


def test_asof_is_one_pass(spark):
    p = spark.createDataFrame(series([float(i % 7) for i in range(100)]), SCHEMA)
    plan = prepare.asof_resample(p)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_smoothing_against_a_plain_loop(spark):
    v = [float((i * 13) % 17) for i in range(60)]
    r = forecast.smoothing_forecast(features.series_arrays(spark.createDataFrame(series(v), SCHEMA)), (0.3,)).first()
    level, sse = v[0], 0.0
    for x in v[1:]:
        sse += (x - level) ** 2
        level += 0.3 * (x - level)
    assert (r.forecast, r.sse) == (pytest.approx(level), pytest.approx(sse))


def test_sources(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "a.csv").write_text("c_1,m_1,5,1.5,2.5,,,,,,\n,m_1,6,1,1,,,,,,\n")
    assert [r.container_id for r in src.ingest_headerless_csv(spark, str(tmp_path / "raw")).collect()] == ["c_1"]
    (tmp_path / "vm").mkdir()
    body = "\n".join(f"{1_700_000_000_000 + i * 1000}; {i}; {i}; {100 if i else 0}" for i in range(5))
    (tmp_path / "vm" / "17.csv").write_text("Timestamp [ms]; CPU usage [%]; Memory usage [KB]; Memory capacity provisioned [KB]\n" + body + "\n")
    got = rows(src.ingest_vm_files(spark, str(tmp_path / "vm"), min_rows=4))
    assert [(r.container_id, r.time_stamp, r[CPU], r[MEM]) for r in got] == [("vm_17", 1_700_000_000 + i, i, i) for i in range(1, 5)]
    src.write_panel(spark.createDataFrame(series([1.0, 2.0]), SCHEMA), str(tmp_path / "out"), ["container_id"])
    assert src.read_panel(spark, str(tmp_path / "out")).count() == 2


def test_every_query_with_sql_has_one(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_bootstrap_has_both_measures_and_a_thousand_replicates(spark):
    rng = np.random.default_rng(5)
    data = [(1, m, f"s{s}", t, float(s + rng.normal()), float(s + rng.normal())) for m in ("x", "y") for s in range(12) for t in range(8)] + [(1, "constant", f"s{s}", t, 4.1, 4.0 + s) for s in range(3) for t in range(3)]
    frame = spark.createDataFrame(data, "horizon int, model string, container_id string, time_stamp long, y_true double, y_pred double")
    got = {r.model: r for r in evaluate.metric_bootstrap(frame).collect()}
    few = {r.model: r for r in evaluate.metric_bootstrap(frame, 200).collect()}
    for m in "xy":
        y, p = (np.array([row[i] for row in data if row[1] == m]) for i in (4, 5))
        assert math.isclose(got[m].mae, np.abs(y - p).mean()) and math.isclose(got[m].r2, 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())
        assert got[m].lo < got[m].mae < got[m].hi and got[m].r2_lo < got[m].r2 < got[m].r2_hi
        assert (got[m].lo, got[m].r2_lo) != (few[m].lo, few[m].r2_lo)
    assert (got["constant"].r2, got["constant"].r2_lo) == (None, None) and math.isclose(got["constant"].mae, np.mean([abs(4.1 - 4.0 - s) for s in range(3)]))


def events_file(folder, users, seconds, values):
    import pyarrow as pa
    import pyarrow.parquet as pq

    ts = pa.array([int(t * 1_000_000) for t in seconds], pa.int64()).cast(pa.timestamp("us"))
    pq.write_table(pa.table({"user_id": pa.array(users, pa.int64()), "ts": ts, "value": pa.array(values, pa.float64())}), folder / "events.parquet")


def test_streamed_interval_against_the_batch_fold(spark, tmp_path):
    from gridlark.plans import streams

    y = np.cumsum(np.random.default_rng(3).normal(size=2600) * np.linspace(0.2, 2, 2600))
    events_file(tmp_path, [7] * len(y), range(0, 300 * len(y), 300), y * 5)
    got = streams.adaptive_interval(spark, str(tmp_path)).toPandas()
    n, misses, width, _ = intervals.adaptive_fold(y[1:], y[:-1], 0.05)
    assert (len(got), got.miss.sum()) == (n, misses) and math.isclose((got.upper - got.lower).sum(), width, rel_tol=1e-6)


def test_streamed_rollup_has_the_last_hour(spark, tmp_path):
    from gridlark.plans import streams

    seconds = [0, 200, 299, 300, 7000, 7100, 9000, 9001, 10_000]
    events_file(tmp_path, [1, 1, 2, 1, 1, 1, 2, 2, 1], seconds, [5.0, 10, 15, 20, 25, 30, 35, 40, 45])
    got = {(r.container_id, r.time_stamp): (r[CPU], r.n) for r in streams.grid_rollup(spark, str(tmp_path)).collect()}
    assert got == {("c_1", 0): (2, 2), ("c_2", 0): (3, 1), ("c_1", 300): (4, 1), ("c_1", 6900): (6, 2), ("c_2", 9000): (8, 2), ("c_1", 9900): (9, 1)}


def test_rows_of_several_batches_update_a_bucket(spark, tmp_path):
    from gridlark.plans import streams
    from gridlark.streaming.jobs import stream_grid_rollup

    schema = f"container_id string, ts timestamp, {CPU} double"
    for i, t in enumerate((10, 20)):
        one = spark.createDataFrame([("a", t, float(i))], f"container_id string, s long, {CPU} double")
        one.select("container_id", F.timestamp_seconds("s").alias("ts"), CPU).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = streams.run_updates(stream_grid_rollup(stream), ["container_id", "time_stamp"]).collect()
    assert [(r.container_id, r.time_stamp, r[CPU], r.n) for r in got] == [("a", 0, 1.0, 2)]


def test_state_of_the_interval_is_restored_by_the_next_run(spark, tmp_path):
    from gridlark.streaming.jobs import stream_adaptive_interval

    y = np.cumsum(np.random.default_rng(4).normal(size=400))
    schema = f"container_id string, time_stamp long, {CPU} double"
    for part in (range(150), range(150, 400)):
        spark.createDataFrame([("a", 300 * t, float(y[t])) for t in part], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        rows = stream_adaptive_interval(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        to = rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
        to.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).toPandas()
    n, misses, width, _ = intervals.adaptive_fold(y[1:], y[:-1], 0.05)
    assert (len(got), got.miss.sum(), got.time_stamp.nunique()) == (n, misses, n) and math.isclose((got.upper - got.lower).sum(), width, rel_tol=1e-9)


def test_rows_behind_the_watermark_are_dropped_by_the_next_run(spark, tmp_path):
    from gridlark.streaming.jobs import stream_grid_rollup

    schema = f"container_id string, ts timestamp, {CPU} double"
    files = ([10, 20, 310], [7000, 20_000], [30, 16_500, 20_050], [40_000])  # 30 is late: the watermark is at 16,400
    for seconds in files:
        one = spark.createDataFrame([("a", t, float(t)) for t in seconds], f"container_id string, s long, {CPU} double")
        one.select("container_id", F.timestamp_seconds("s").alias("ts"), CPU).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        rows = stream_grid_rollup(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        to = rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
        to.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = {r.time_stamp: (r[CPU], r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {0: (20, 2), 300: (310, 1), 6900: (7000, 1), 16_500: (16_500, 1), 19_800: (20_050, 2)}


def test_bounds_of_all_step_sizes_against_a_plain_loop(spark):
    rng = np.random.default_rng(5)
    y, p = np.cumsum(rng.normal(size=120)), rng.normal(size=120)
    rows = [(2, "m", c, int(t), float(y[t]), float(p[t])) for c, n in (("a", 120), ("b", 1)) for t in rng.permutation(n)]
    got = intervals.expert_bounds(spark.createDataFrame(rows, "horizon int, model string, container_id string, time_stamp long, y_true double, y_pred double")).orderBy("time_stamp").toPandas()
    halves, missed = [], []
    for gamma in (0.01, 0.02, 0.05, 0.1):
        a, q = 0.2, []
        for k in range(60, 120):
            q.append(np.quantile(np.abs(y - p)[:k], 1 - a))
            a = min(0.99, max(0.01, a + gamma * (0.2 - (abs(y[k] - p[k]) > q[-1]))))
        halves.append(q)
        missed.append(np.mean(np.abs(y - p)[60:] > q))
    w = np.exp(-10 * np.array(missed))
    half = w @ np.array(halves) / w.sum()
    assert got.time_stamp.tolist() == list(range(60, 120)) and set(got.container_id) == {"a"}
    assert np.allclose(got.lower, p[60:] - half) and np.allclose(got.upper, p[60:] + half)


def test_bias_corrected_interval_against_a_plain_version(spark):
    from hashlib import md5
    from statistics import NormalDist

    from gridlark.functions.expressions import normal_inverse
    from gridlark.operators.boards import auc_bca

    normal, rng = NormalDist(), np.random.default_rng(6)
    ps = [1e-6, 0.001, 0.02, 0.03, 0.4, 0.5, 0.77, 0.99, 1 - 1e-6]
    for p, z in spark.createDataFrame([(p,) for p in ps], "p double").select("p", normal_inverse(F.col("p"))).collect():
        assert math.isclose(z, normal.inv_cdf(p), abs_tol=1e-7)

    y = (rng.random(60) < 0.4).astype(int)
    x = np.round(rng.normal(size=60) + y, 1)  # with ties
    rows = [("g", f"k{i}", float(x[i]), int(y[i])) for i in range(60)] + [("g", "none", None, 1), ("one", "a", 1.0, 1), ("one", "b", 2.0, 1)]
    got = {r.g: r for r in auc_bca(spark.createDataFrame(rows, "g string, k string, x double, y int"), ["g"], "x", "y", "k", 300).collect()}

    def auc(w):
        up, down = w[y == 1], w[y == 0]
        wins = (x[y == 1][:, None] > x[y == 0]) + (x[y == 1][:, None] == x[y == 0]) / 2
        return float(up @ wins @ down / (up.sum() * down.sum()))

    own, steps = auc(np.ones(60)), np.cumsum([math.exp(-1) / math.factorial(k) for k in range(6)])
    boot = np.array([auc(np.array([np.sum(int(md5(f"k{i}/{b}".encode()).hexdigest()[:8], 16) / 2**32 >= steps) for i in range(60)])) for b in range(1, 301)])
    left = np.array([auc(1.0 - (np.arange(60) == i)) for i in range(60)])
    d = left.mean() - left
    a, z0 = (d**3).sum() / (6 * (d**2).sum() ** 1.5), normal.inv_cdf((boot < own).mean())
    want = [np.quantile(boot, normal.cdf(z0 + (z0 + z) / (1 - a * (z0 + z)))) for z in (normal.inv_cdf(0.025), normal.inv_cdf(0.975))]
    assert np.allclose([got["g"].auc, got["g"].z0, got["g"].acceleration, got["g"].lo, got["g"].hi], [own, z0, a, *want], atol=1e-6) and got["g"].n == 60
    assert [got["one"][c] for c in ("auc", "z0", "acceleration", "lo", "hi")] == [None] * 5

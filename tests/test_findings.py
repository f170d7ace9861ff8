"""Steps that findings of the reviews were about: nothing shuffled twice, no group in one task, exact results."""

import math

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from gridlark.functions.expressions import round_to
from gridlark.operators import evaluate, forecast, intervals, learned, prepare, profile, selection
from gridlark.operators import features as ft
from gridlark.sources.panel import CPU, MEM

H = (1, 2)


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(5)
    rows = [(f"s{k}", 3600 * t, float(np.round(rng.gamma(2, 10), 2)) if (t + k) % 17 else None, float(t % 7)) for k in range(5) for t in range(90 + k)]
    df = spark.createDataFrame(rows, f"container_id string, time_stamp long, {CPU} double, {MEM} double")
    return df.repartition(4, "container_id")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_round_to(spark):
    values = [0.125, -0.125, 2.5, -2.5, 1.005, 33.3333333333, 0.0, 1e12, math.inf, None]
    got = [r.x for r in spark.createDataFrame([(v,) for v in values], "v double").select(round_to(F.col("v"), 2).alias("x")).collect()]
    assert got[:4] == [0.13, -0.13, 2.5, -2.5] and got[5:] == [33.33, 0.0, 1e12, math.inf, None]


def test_long_forecasts_stay_with_their_series(panel):
    w = forecast.wide_forecasts(panel, H, 24)
    long = forecast.long_forecasts(w)
    assert long.count() == 4 * w.count()
    assert plan(evaluate.series_errors(long)).count("Exchange") == plan(panel).count("Exchange")


def test_places(panel):
    got = forecast.wide_forecasts(panel, H, 24, placed=True).toPandas()
    for _, g in got.groupby(["container_id", "horizon"]):
        g = g.sort_values("time_stamp")
        assert g.place.tolist() == list(range(1, len(g) + 1)) and set(g.n) == {len(g)}


def test_error_correlation(panel):
    w = forecast.wide_forecasts(panel, H, 24)
    p = w.toPandas()
    got = evaluate.error_correlation(w, list(forecast.MODELS), least=2).collect()
    assert len(got) == 6 * len(H)
    for r in got:
        g = p[p.horizon == r.horizon]
        assert r.n == len(g) and r.error_corr == pytest.approx(np.corrcoef(g[r.model_a] - g.y_true, g[r.model_b] - g.y_true)[0, 1])


def test_split_conformal_of_panel_is_that_of_rows(panel):
    rows = forecast.forecast_columns(panel, H, 24)
    got = {(r.horizon, r.model): r for r in intervals.split_conformal_panel(rows, H, {"persistence": CPU, "seasonal": "s_{h}", "mean6": "mean6", "mean24": "mean24"}, CPU).collect()}
    want = intervals.split_conformal(forecast.long_forecasts(forecast.wide_forecasts(panel, H, 24))).collect()
    assert len(got) == len(want) == 8
    for w in want:
        g = got[w.horizon, w.model]
        assert g.n == w.n and g.coverage == pytest.approx(w.coverage) and g.width == pytest.approx(w.width)


def test_combined_is_apply_weights(spark, panel):
    three = ("seasonal", "mean6", "mean24")
    w = forecast.wide_forecasts(panel, H, 24)
    weights = forecast.nnls_weights(w, three, ["horizon"], leave_out=True)
    got = forecast.combined(w, weights, three, ["horizon"])
    assert plan(got).count("Exchange hashpartitioning(container_id") == plan(w).count("Exchange hashpartitioning(container_id")
    keys = ["container_id", "time_stamp", "horizon", "left_out"]
    both = got.toPandas().merge(forecast.apply_weights(forecast.long_forecasts(w, three), weights, ["horizon"]).toPandas(), on=keys)
    assert len(both) == 4 * w.count() and np.allclose(both.y_pred_x, both.y_pred_y)


@pytest.mark.parametrize("level", [0.0, 0.5, 0.8, 1.0])
def test_binned_percentile(spark, level):
    rng = np.random.default_rng(8)
    values = {"a": np.r_[rng.random(500) * 3, np.zeros(300)], "b": np.array([7.0]), "c": -rng.random(40)}
    rows = spark.createDataFrame([(k, float(v)) for k, x in values.items() for v in x] + [("a", None)], "k string, v double")
    got = {r.k: r.p for r in selection.binned_percentile(rows, ["k"], "v", level, "p", 0.25).collect()}
    assert got == pytest.approx({k: float(np.quantile(x, level)) for k, x in values.items()})
    assert selection.binned_percentile(rows, [], "v", level, "p").first().p == pytest.approx(float(np.quantile(np.concatenate(list(values.values())), level)))


def test_interval_scores_of_nothing(spark):
    none = spark.createDataFrame([], "y_true double, lower double, upper double")
    assert intervals.interval_scores(none, []).count() == 1


def test_buffer_filled_at_once():
    errors = np.random.default_rng(1).random(60).tolist()
    one, all_ = (intervals.AdaptiveSeries((0.01, 0.1), 0.2, 20, 30) for _ in range(2))
    for e in errors:
        one.feed(e)
    all_.feed_all(errors[:10])
    all_.feed_all(errors[10:])
    assert (one.misses, one.widths, one.levels, one.ordered, list(one.recent), one.seen) == (all_.misses, all_.widths, all_.levels, all_.ordered, list(all_.recent), all_.seen)


def test_newest_rows_marked_before_the_features(panel):
    a = ft.latest_feature_row(ft.feature_frame(panel, 2, 24)).toPandas().set_index("container_id").sort_index()
    b = ft.latest_feature_row(ft.feature_frame(ft.mark_newest(panel), 2, 24)).toPandas().set_index("container_id").sort_index()
    assert len(a) == 5 and a.equals(b[a.columns]) and set(a.columns) == set(b.columns)


@pytest.mark.parametrize("kind", ["forest", "boosted"])
def test_asked_trees_forecast_as_the_model(spark, kind):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 3))
    rows = spark.createDataFrame([(*map(float, v), float(v[0] - v[1] ** 2)) for v in x], "a double, b double, c double, cpu_residual double")
    model = learned.tree_steps(["a", "b", "c"], kind, 4, 3, 5).fit(rows)
    trees = [learned._splits(t._java_obj.rootNode()) for t in model.stages[-1].trees]
    share = np.array(model.stages[-1].treeWeights) / (1 if kind == "boosted" else len(trees))
    got = sum(s * learned._ask(t, lambda f: x[:, f]) for s, t in zip(share, trees, strict=True))
    assert np.allclose(got, [r.prediction for r in model.transform(rows).select("prediction").collect()])


def test_features_are_worked_out_once(spark, panel, monkeypatch):
    wrote = []
    real = learned.materialise
    monkeypatch.setattr(learned, "materialise", lambda df, name: wrote.append(name) or real(df, name))
    rows = learned.residual_table(ft.feature_frame(panel, 2, 24), ["cpu_lag_3"], "residuals")
    assert wrote == ["residuals"] and "Window" not in plan(rows)


def test_penalty_against_fractions(spark):
    """The penalty of least left-out error by exact fractions, where the penalties hardly differ (the plain sums passed this too)."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 2)) * 10
    y = x @ [0.02, -0.01] + rng.normal(size=40) * 1e4
    rows = spark.createDataFrame([("h", 0.0, float(b), *map(float, a)) for a, b in zip(x, y, strict=True)], "horizon string, y_naive double, y_true double, m1 double, m2 double")
    wide = rows.crossJoin(spark.range(20)).drop("id")
    alphas = (1e-7, 1e-6, 1e-5, 1e-4)
    sums = forecast.gram(wide, ("m1", "m2"), ["horizon"]).collect()
    alpha, _ = forecast.ridge_cv(wide, ("m1", "m2"), ["horizon"], sums, alphas)["h",]
    from fractions import Fraction as Q

    xx = [[20 * sum(Q(float(r[i])) * Q(float(r[j])) for r in x) for j in range(2)] for i in range(2)]
    xy = [20 * sum(Q(float(r[i])) * Q(float(b)) for r, b in zip(x, y, strict=True)) for i in range(2)]

    def error(a):
        p, q, r = xx[0][0] + Q(a), xx[0][1], xx[1][1] + Q(a)
        det = p * r - q * q
        w = ((r * xy[0] - q * xy[1]) / det, (p * xy[1] - q * xy[0]) / det)
        out = Q(0)
        for (u, v), b in zip(x.tolist(), y.tolist(), strict=True):
            u, v = Q(u), Q(v)
            h = (r * u * u - 2 * q * u * v + p * v * v) / det
            out += ((Q(b) - w[0] * u - w[1] * v) / (1 - h)) ** 2
        return out

    assert alpha == min(alphas, key=error)


def test_features_in_batches_and_short_methods(spark, panel):
    """rows read batch by batch give what pandas gives, and no row of many columns goes through one whole-stage method, too long to be compiled."""
    was = {c: spark.conf.get(c) for c in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        frame = ft.feature_frame(panel, 2, 24)
        assert not [line for line in plan(frame).split("\n") if "*(" in line and "Project" in line and "more fields" in line]
        got = frame.toPandas()
    finally:
        for c, v in was.items():
            spark.conf.set(c, v)
    rows = panel.toPandas()
    assert len(got) == len(rows)
    for name, g in rows.groupby("container_id"):
        g, f = g.sort_values("time_stamp"), got[got.container_id == name].sort_values("time_stamp")
        for metric, c in ft.METRICS.items():
            x = g[c].reset_index(drop=True)
            for w in ft.WINDOWS:
                over = x.shift(3).rolling(w, min_periods=1)
                for kind in ("mean", "min", "max"):
                    assert np.allclose(f[f"{metric}_{kind}_{w}"].to_numpy(float), getattr(over, kind)(), equal_nan=True)
                assert np.allclose(f[f"{metric}_std_{w}"].to_numpy(float), over.std().fillna(0), atol=1e-6)
            assert np.allclose(f[f"{metric}_lag_50"].to_numpy(float), x.shift(50), equal_nan=True) and np.allclose(f[f"{metric}_target"].to_numpy(float), x.shift(-2), equal_nan=True)
            assert np.allclose(f[f"{metric}_same_time_1d"].to_numpy(float), x.shift(27).fillna(x.shift(3)), equal_nan=True)


def test_workload_goes_with_the_rows(spark, panel):
    """the class of a series from the panel's own sort, and all models' R² from wide rows: as by joining and grouping long rows."""
    from __spark_entry__ import queries

    some = panel.unionByName(spark.createDataFrame([("lone", 0, 1.0, 1.0), *[("blank", t, None, 2.0) for t in range(3)]], panel.schema))
    got = profile.with_workload(some)
    p = profile.workload_profile(some)
    want = some.join(p.select("container_id", profile.workload_name(F.col("cpu_mean"), F.col("cpu_std"), F.col("mem_mean")).alias("workload")), "container_id")
    assert got.count() == panel.count() and got.exceptAll(want.select(got.columns)).count() == 0
    w = forecast.wide_forecasts(got, H, 24, kept=("workload",))
    by = ["workload", "horizon"]
    a = {tuple(r[c] for c in [*by, "model"]): r for r in evaluate.models_r2(w, forecast.MODELS, by).collect()}
    long = forecast.long_forecasts(w, more=("workload",))
    b = evaluate.forecast_metrics(long, [*by, "model"]).collect()
    assert len(a) == len(b) and all(a[r.workload, r.horizon, r.model].n == r.n and a[r.workload, r.horizon, r.model].r2_model == pytest.approx(r.r2) for r in b)
    assert "Join" not in plan(queries()["cluster_metrics"](spark, "/root/testdata/sf0.001"))


@pytest.mark.parametrize("size", ["7", "10000"])
def test_autocovariances_of_a_panel(spark, panel, size):
    """sums from the panel's own rows, over batches smaller than the lags too, are those of long rows; the queries sort no long rows."""
    from __spark_entry__ import queries

    some = panel.unionByName(spark.createDataFrame([(f"x{k}", 3600 * t, float((t * k) % 13), 1.0) for k in (1, 2, 3) for t in range(24 + k)], panel.schema)).repartition(3, "container_id")
    models = {"seasonal": "s_{h}", "mean6": "mean6", "mean24": "mean24"}
    rows, long = forecast.forecast_columns(some, H, 24), forecast.long_forecasts(forecast.wide_forecasts(some, H, 24), tuple(models))
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        for value in (evaluate.loss_difference, evaluate.residual):
            got = {(r.horizon, r.model): r.asDict() for r in evaluate.panel_autocovariances(rows, H, models, CPU, value, 11).collect()}
            want = evaluate.autocovariances(long.withColumn("v", value(F.col("y_true"), F.col("y_pred"), F.col("y_naive"))), ["horizon", "model"], "v", 11).collect()
            assert len(got) == len(want) == 6
            for w in want:
                assert got[w.horizon, w.model] == pytest.approx(w.asDict())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    for name in ("dm_test", "residual_diagnostics"):
        p = plan(queries()[name](spark, "/root/testdata/sf0.001"))
        assert "collect_list" not in p and "Sort [horizon" not in p


def test_policy_sums_over_batches(spark, panel):
    """every setting's sums from the panel's rows as they come, over borders of batches; rows are not multiplied by lags and targets."""
    grid = {"targets": (0.5, 0.8), "margins": (1.0, 1.6), "lags": (1, 4)}
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
        sweep = evaluate.scaling_policy_sweep(panel, CPU, request=0.05, **grid)
        assert "Generate" not in plan(sweep)
        got = {(r.target, r.margin, r.lag): r for r in sweep.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    rows = panel.toPandas().sort_values(["container_id", "time_stamp"])
    assert len(got) == 8
    for (t, m, k), r in got.items():
        p = rows.assign(demand=rows[CPU] / 100, seen=rows.groupby("container_id")[CPU].shift(k) / 100).dropna()
        capacity = np.clip(np.ceil(np.round(p.seen * m / (0.05 * t), 9)), 1, 100) * 0.05
        assert r.violation == pytest.approx((p.demand > capacity).mean())
        assert r.waste == pytest.approx((capacity - p.demand).clip(lower=0).sum() / capacity.sum())
        assert r.severity == pytest.approx((p.demand - capacity).clip(lower=0).sum() / p.demand.sum())


@pytest.mark.parametrize("size", ["2", "10000"])
def test_policy_sums_of_runs(spark, size):
    """a raw row's run of grid points is one row of the sweep, whose sums are those of all points, for lags within, over and far beyond a run; the queries make no points and sort once."""
    from __spark_entry__ import queries

    rng = np.random.default_rng(11)
    raw = []
    for k in range(6):
        gaps = rng.choice([40, 900, 1800, 3600, 7200, 20000, 200000], 3 if k == 5 else 40)  # the last series is too short
        raw += [(f"s{k}", int(t), None if i < k % 3 or i % 11 == 5 else float(np.round(rng.gamma(2, 15), 2)), 0.0) for i, t in enumerate(1000 * k + np.cumsum(gaps))]
    rows = spark.createDataFrame(raw, f"container_id string, time_stamp long, {CPU} double, {MEM} double").repartition(2, "container_id")
    runs, points = prepare.asof_runs(rows, 3600, (CPU,)), prepare.asof_resample(rows, 3600, (CPU,)).toPandas().sort_values(["container_id", "time_stamp"])
    assert runs.agg(F.sum("points")).first()[0] == len(points) > 3 * runs.count()
    grid = {"targets": (0.5, 0.8), "margins": (1.0, 1.6), "lags": (1, 4, 30)}
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        none = runs.unionByName(runs.withColumns({"time_stamp": F.col("time_stamp") + 1, "points": F.lit(0).cast("long"), CPU: F.lit(99.0)}))
        for some in (runs, none):
            got = {(r.target, r.margin, r.lag): r for r in evaluate.scaling_policy_sweep(some, CPU, request=0.05, points="points", **grid).collect()}
            assert len(got) == 12
            for (t, m, k), r in got.items():
                p = points.assign(demand=points[CPU] / 100, seen=points.groupby("container_id")[CPU].shift(k) / 100).dropna()
                capacity = np.clip(np.ceil(np.round(p.seen * m / (0.05 * t), 9)), 1, 100) * 0.05
                assert r.violation == pytest.approx((p.demand > capacity).mean())
                assert r.waste == pytest.approx((capacity - p.demand).clip(lower=0).sum() / capacity.sum())
                assert r.severity == pytest.approx((p.demand - capacity).clip(lower=0).sum() / p.demand.sum())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    for name in ("scaling_policy_sweep", "pareto_front", "distinct_points"):
        p = plan(queries()[name](spark, "/root/testdata/sf0.001"))
        assert "Generate" not in p and p.count("Sort [container_id") == 1


def test_stratified_draws_are_never_rows(spark):
    """The AUCs of the replicates against a plain loop; no row for each cell and replicate, no join of draws."""
    from hashlib import md5

    from gridlark.operators import boards

    rng = np.random.default_rng(8)
    rows = [("g", f"c{k:03}", float(rng.integers(9)), int(rng.integers(2))) for k in range(60)] + [("one", f"c{k}", float(k), 1) for k in range(4)]
    cells = spark.createDataFrame(rows, "g string, k string, s double, y int")
    got = boards.auc_bca_stratified(cells, ["g"], "s", "y", "k", 20)
    assert "Generate explode(sequence" not in plan(got)
    placed = cells.withColumns({"place": F.row_number().over(Window.partitionBy("g", "y").orderBy("k")), "m": F.count("*").over(Window.partitionBy("g", "y"))})
    boot = {r.g: r.boot for r in boards._stratified_aucs(placed, ["g"], "s", "y", "k", 20).collect()}
    of = {y: [r[2] for r in sorted(rows) if r[0] == "g" and r[3] == y] for y in (0, 1)}
    want = []
    for i in range(1, 21):
        drawn = {y: [of[y][int(int(md5(f"{r[1]}/{i}".encode()).hexdigest()[:8], 16) / 2**32 * len(of[y]))] for r in rows if r[0] == "g" and r[3] == y] for y in (0, 1)}
        want.append(np.mean([(p > q) + (p == q) / 2 for p in drawn[1] for q in drawn[0]]))
    assert set(boot) == {"g"} and boot["g"] == pytest.approx(sorted(want), abs=1e-12)
    rows = {r.g: r for r in got.collect()}
    assert rows["one"].auc is None and rows["g"].lo <= rows["g"].auc <= rows["g"].hi


def test_origins_without_a_join(spark):
    """The marked rows are the rolling origins of every series, short ones among them."""
    rows = [(f"s{n}", 60 * t, float(t), 0.0) for n in (10, 24, 26, 31, 40, 45, 97, 400) for t in range(n)]
    panel = spark.createDataFrame(rows, f"container_id string, time_stamp long, {CPU} double, {MEM} double")
    marked = ft.mark_origins(panel, (1, 2, 12), (20, 50))
    assert "Join" not in plan(marked) and plan(marked).count("Exchange hashpartitioning") == 1
    for k in (20, 50):
        got = {(r.container_id, h, r.time_stamp // 60) for r in marked.collect() for i, h in enumerate((1, 2, 12)) if r[f"origins_{k}"] & 2**i}
        want = {(r.container_id, r.horizon, r.origin) for r in ft.rolling_origins(panel, (1, 2, 12), k).collect()}
        assert got == want


@pytest.mark.parametrize("buffer", [2000, 9])
def test_bounds_of_a_panel_equal_those_of_its_rows(spark, panel, buffer):
    """One group a series against two readings of the long rows, with a buffer that slides too; no join and no shuffle of forecasts."""
    short = spark.createDataFrame([("tiny", 3600 * t, float(t % 3), 1.0) for t in range(26)], f"container_id string, time_stamp long, {CPU} double, {MEM} double")
    both = panel.unionByName(short).repartition(4, "container_id")
    want = intervals.expert_bounds(forecast.long_forecasts(forecast.wide_forecasts(both, H, 24), ("mean24",)), (0.1, 0.01, 0.05), buffer=buffer)
    got = intervals.expert_bounds_panel(forecast.forecast_columns(both, H, 24), H, {"mean24": "mean24"}, CPU, (0.1, 0.01, 0.05), buffer=buffer, kept=("s_{h}", "mean6"))
    assert "Join" not in plan(got) and plan(got).count("Exchange") == plan(both).count("Exchange")
    key = ["horizon", "container_id", "time_stamp"]
    a, b = (x.toPandas().sort_values(key).reset_index(drop=True) for x in (got, want))
    assert len(a) == len(b) > 0 and (a[key] == b[key]).all().all()
    assert a[["y_true", "lower", "upper"]].to_numpy() == pytest.approx(b[["y_true", "lower", "upper"]].to_numpy(), abs=1e-12)

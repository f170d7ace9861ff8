"""Queries: leaderboards, audits, shares, permutation tests, and results as one long table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expressions import INVERSE_MIDDLE, INVERSE_TAIL, INVERSE_TAIL_FROM, correlation, ratio, round_to
from ..functions.expressions import r2 as r2_of
from ..operators import boards as bd
from ..operators import evaluate as ev
from ..operators import features as ft
from ..operators import forecast as fc
from ..operators import intervals as iv
from ..operators import resume
from ..operators.forecast import long_forecasts
from ..operators.selection import binned_percentile
from ..registry import query
from ..scratch import materialise, scratch_path
from .fixtures import GRID, HORIZONS, LONG, R2, WIDE, grid, long, r, rounded, wide

MODELS = list(fc.MODELS)
D = 8


def sql(prefix: str, rest: str) -> str:
    return f"WITH {prefix} {rest}"


def r2(p: str) -> str:
    return R2.format(p=p)


_METRIC = f", m AS (SELECT horizon, model, count(*) AS n, {r2('y_pred')} AS r2, avg(abs(y_true - y_pred)) AS mae, sqrt(avg((y_true - y_pred) * (y_true - y_pred))) AS rmse FROM fc GROUP BY 1, 2)"
_BOARD = _METRIC + f", board AS (SELECT horizon, {', '.join(f'max(r2) FILTER (model = {m!r}) AS {m}' for m in MODELS)} FROM m GROUP BY 1)"


def _metrics(spark, sf_dir):
    return ev.forecast_metrics(long(spark, sf_dir), ["horizon", "model"])


@query("pivot_metric", sql(LONG + _METRIC, f"SELECT horizon::BIGINT AS horizon, {', '.join(r(f'max(mae) FILTER (model = {m!r})', m, D) for m in MODELS)} FROM m GROUP BY 1"))
def pivot_metric(spark, sf_dir):
    return rounded(bd.pivot_metric(_metrics(spark, sf_dir), ["horizon"], "model", MODELS, "mae"), D)


@query("best_model", sql(LONG + _BOARD, f"SELECT horizon::BIGINT AS horizon, CASE {' '.join(f'WHEN {m} = greatest({", ".join(MODELS)}) THEN {m!r}' for m in MODELS)} END AS best, {r(f'greatest({", ".join(MODELS)})', 'best_r2', D)} FROM board"))
def best_model(spark, sf_dir):
    board = bd.pivot_metric(_metrics(spark, sf_dir), ["horizon"], "model", MODELS, "r2")
    return rounded(bd.best_model(board, MODELS).select("horizon", "best", "best_r2"), D)


@query("leaderboard_merge", sql(LONG + _METRIC, f"SELECT a.horizon::BIGINT AS horizon, {r('a.r2', 'naive_r2', D)}, a.n::BIGINT AS n_points, {r('b.r2', 'mean24_r2', D)}, b.n::BIGINT AS mean24_n_points, {r('100 * (b.r2 - a.r2)', 'mean24_delta_pp', 6)}, a.n = b.n AS same_points FROM m a LEFT JOIN m b ON a.horizon = b.horizon AND b.model = 'mean24' AND b.horizon > 1 WHERE a.model = 'persistence'"))
def leaderboard_merge(spark, sf_dir):
    """The naive leaderboard with a model that has no results for the first horizon."""
    m = _metrics(spark, sf_dir).withColumnRenamed("n", "n_points")
    board = m.filter("model = 'persistence'").select("horizon", F.col("r2").alias("naive_r2"), "n_points")
    got = bd.leaderboard_merge(board, m.filter("model = 'mean24' and horizon > 1"), ["horizon"], "mean24")
    return rounded(got, D, {"mean24_delta_pp": 6})


@query("fixed_order_sort", sql(LONG + _METRIC, f"SELECT horizon::BIGINT AS horizon, model, row_number() OVER (ORDER BY CASE model WHEN 'mean24' THEN 0 WHEN 'persistence' THEN 1 ELSE 999 END, CASE horizon WHEN 12 THEN 0 WHEN 6 THEN 1 WHEN 2 THEN 2 ELSE 999 END, model)::BIGINT AS place, {r('r2', 'r2', D)} FROM m"))
def fixed_order_sort(spark, sf_dir):
    """Models and horizons in a given order, unknown ones last; the place of each row of the board (few rows: models by horizons)."""
    from pyspark.sql import Window

    order = Window.orderBy(bd.fixed_order("model", ["mean24", "persistence"]), bd.fixed_order("horizon", [12, 6, 2]), "model")
    return rounded(_metrics(spark, sf_dir).select("horizon", "model", F.row_number().over(order).alias("place"), "r2"), D)


_AUDIT = f"""{_METRIC}, p AS (SELECT horizon, model, 'mae' AS metric, round(mae, 2) AS expected FROM m UNION ALL SELECT horizon, model, 'rmse', floor(rmse * 100) / 100 FROM m),
a AS (SELECT horizon, model, 'mae' AS metric, mae AS actual FROM m WHERE model <> 'mean6' UNION ALL SELECT horizon, model, 'rmse', rmse FROM m)"""


@query("published_value_audit", sql(LONG + _AUDIT, f"SELECT p.horizon::BIGINT AS horizon, p.model, p.metric, {r('expected', 'expected')}, {r('actual', 'actual')}, {r('abs(expected - actual)', 'gap')}, CASE WHEN actual IS NULL THEN 'MISSING' WHEN abs(actual) > 1e10 THEN 'OVERFLOW' WHEN abs(expected - actual) < 0.006 THEN 'PASS' ELSE 'FAIL' END AS status FROM p LEFT JOIN a USING (horizon, model, metric)"))
def published_value_audit(spark, sf_dir):
    """A table with two digits (one metric rounded, one cut off) against the recomputed metrics, of which one model's MAE is missing."""
    m = _metrics(spark, sf_dir)
    each = lambda mae, rmse, name: m.select("horizon", "model", F.explode(F.array(F.struct(F.lit("mae").alias("metric"), mae.alias(name)), F.struct(F.lit("rmse").alias("metric"), rmse.alias(name)))).alias("v")).select("horizon", "model", "v.*")
    expected = each(F.round("mae", 2), F.floor(F.col("rmse") * 100) / 100, "expected")
    actual = each(F.col("mae"), F.col("rmse"), "actual").filter("metric <> 'mae' or model <> 'mean6'")
    return rounded(bd.published_value_audit(expected, actual, ["horizon", "model", "metric"], 0.006))


_AVG = "(seasonal + mean6 + mean24) / 3"


@query("simple_average", sql(WIDE, f"SELECT horizon::BIGINT AS horizon, {r(R2.format(p=_AVG), 'r2', D)}, {r(f'avg(abs(y_true - {_AVG}))', 'mae', D)} FROM wide GROUP BY 1"))
def simple_average(spark, sf_dir):
    p = bd.simple_average(wide(spark, sf_dir), ["seasonal", "mean6", "mean24"])
    return rounded(wide(spark, sf_dir).groupBy("horizon").agg(r2_of(F.col("y_true"), p).alias("r2"), F.avg(F.abs(F.col("y_true") - p)).alias("mae")), D)


_RESULTS = _METRIC + ", s AS (" + " UNION ALL ".join(f"SELECT horizon, model AS stage, '{x}' AS metric, {x} AS value FROM m" for x in ("r2", "mae", "rmse")) + ")"


@query("stage_metrics", sql(LONG + _RESULTS, f"SELECT horizon::BIGINT AS horizon, stage, metric, {r('value', 'value', D)} FROM s"))
def stage_metrics(spark, sf_dir):
    """All scores as one long table, a row for each horizon, stage and metric."""
    m = _metrics(spark, sf_dir).withColumnRenamed("model", "stage")
    return rounded(m.unpivot(["horizon", "stage"], ["r2", "mae", "rmse"], "metric", "value"), D)


@query("stage_metrics_resumed", sql(LONG + _RESULTS, f"SELECT 'events' AS dataset, horizon::BIGINT AS horizon, stage, metric, {r('value', 'value', D)}, true AS timed FROM s"))
def stage_metrics_resumed(spark, sf_dir):
    """The same scores filled in by two runs, the second of which finds some horizons done."""
    path = scratch_path(spark, "stages")
    rows = long(spark, sf_dir)

    def compute(_, horizon):
        m = ev.forecast_metrics(rows.filter(F.col("horizon") == horizon), ["model"]).withColumnRenamed("model", "stage")
        return m.unpivot(["stage"], ["r2", "mae", "rmse"], "metric", "value")

    for part in (HORIZONS[:2], HORIZONS):
        resume.run_missing(spark, path, [("events", h) for h in part], compute)
    got = resume.stage_table(spark, path)
    return rounded(got.select("dataset", "horizon", "stage", "metric", "value", (F.col("elapsed_s") > 0).alias("timed")), D)


@query("results_summary", sql(LONG + _RESULTS, f"SELECT horizon::BIGINT AS horizon, {', '.join(r(f'max(value) FILTER (stage = {m!r} AND metric = {x!r})', f'{m}_{x}', D) for m in MODELS for x in ('r2', 'mae'))} FROM s GROUP BY 1"))
def results_summary(spark, sf_dir):
    s = stage_metrics(spark, sf_dir).filter("metric in ('r2', 'mae')").withColumn("name", F.concat_ws("_", "stage", "metric"))
    return bd.pivot_metric(s, ["horizon"], "name", [f"{m}_{x}" for m in MODELS for x in ("r2", "mae")], "value")


_ABS = """, iv AS (SELECT horizon, model, container_id, time_stamp, y_true, y_naive, y_pred - y_naive AS p, abs(y_true - y_pred) AS e, row_number() OVER w AS k, count(*) OVER (PARTITION BY horizon, model, container_id) AS n FROM fc WHERE model <> 'persistence' WINDOW w AS (PARTITION BY horizon, model, container_id ORDER BY time_stamp)),
w AS (SELECT horizon, model, quantile_cont(e, 0.8) AS q FROM iv WHERE k * 2 <= n GROUP BY 1, 2),
ab AS (SELECT horizon, model, y_true, y_naive + (p - q) AS lower, y_naive + (p + q) AS upper FROM iv JOIN w USING (horizon, model) WHERE k * 2 > n)"""


@query("to_absolute_intervals", sql(LONG + _ABS, f"SELECT horizon::BIGINT AS horizon, model, count(*)::BIGINT AS n, {r('100 * avg((y_true BETWEEN lower AND upper)::INT)', 'coverage_pct', 2)}, {r('avg(lower)', 'mean_lower')}, {r('avg(upper)', 'mean_upper')} FROM ab GROUP BY 1, 2"))
def to_absolute_intervals(spark, sf_dir):
    """Residual intervals from the earlier half of every series, as intervals of the target on the later half."""
    rows = long_forecasts(wide(spark, sf_dir, placed=True), tuple(m for m in MODELS if m != "persistence"), ("place", "n"))
    rows = rows.withColumn("early", F.col("place") * 2 <= F.col("n")).withColumn("p", F.col("y_pred") - F.col("y_naive")).withColumn("e", F.abs(F.col("y_true") - F.col("y_pred")))
    early = materialise(rows.filter("early").select("horizon", "model", "e"), "residuals")  # read twice
    q = binned_percentile(early, ["horizon", "model"], "e", 0.8, "q")
    late = rows.filter("not early").join(F.broadcast(q), ["horizon", "model"]).withColumn("lower", F.col("p") - F.col("q")).withColumn("upper", F.col("p") + F.col("q"))
    got = iv.to_absolute(late).groupBy("horizon", "model").agg(F.count("*").alias("n"), (100 * F.avg(F.col("y_true").between(F.col("lower"), F.col("upper")).cast("double"))).alias("coverage_pct"), F.avg("lower").alias("mean_lower"), F.avg("upper").alias("mean_upper"))
    return rounded(got, 6, {"coverage_pct": 2})


_FEATURES = ["cpu_lag_3", "cpu_mean_6", "cpu_mean_24", "cpu_std_12", "cpu_max_48", "mem_lag_3", "mem_mean_6", "mem_std_12"]
_GW = "OVER (PARTITION BY container_id ORDER BY time_stamp"


def _importance(spark, sf_dir):
    """Absolute correlation of some features with the target two steps ahead."""
    frame = ft.feature_frame(grid(spark, sf_dir), 2, 24)
    got = frame.agg(*[F.abs(correlation(F.col(c), F.col("cpu_target"))).alias(c) for c in _FEATURES])
    return got.unpivot([], _FEATURES, "feature", "importance").withColumn("resource", F.substring_index("feature", "_", 1))


def _source(c: str) -> str:
    metric, kind, n = c.split("_")
    if kind == "lag":
        return f"lag({metric}, {n}) {_GW})"
    call = {"mean": "avg", "max": "max", "std": "stddev_samp"}[kind]
    out = f"{call}({metric}) {_GW} ROWS BETWEEN {int(n) + 2} PRECEDING AND 3 PRECEDING)"
    return f"coalesce({out}, 0)" if kind == "std" else out


_IMP = f""", fr AS (SELECT lead(cpu, 2) {_GW}) AS y, {', '.join(f'{_source(c)} AS {c}' for c in _FEATURES)} FROM grid),
imp AS ({' UNION ALL '.join(f"SELECT '{c}' AS feature, '{c.split('_')[0]}' AS resource, abs(covar_samp(CASE WHEN y IS NOT NULL THEN {c} END, CASE WHEN {c} IS NOT NULL THEN y END) / nullif(stddev_samp(CASE WHEN y IS NOT NULL THEN {c} END) * stddev_samp(CASE WHEN {c} IS NOT NULL THEN y END), 0)) AS importance FROM fr" for c in _FEATURES)})"""


@query("top_features", sql(GRID + _IMP, f"SELECT feature, {r('importance', 'importance')} FROM imp ORDER BY importance DESC, feature LIMIT 5"))
def top_features(spark, sf_dir):
    return rounded(bd.top_features(_importance(spark, sf_dir), 5))


@query("importance_shares", sql(GRID + _IMP, f", g AS (SELECT resource, sum(importance) AS i, count(*) AS n FROM imp GROUP BY 1) SELECT resource, {r('i', 'importance')}, n::BIGINT AS n_features, {r('100 * i / sum(i) OVER ()', 'share_pct', 4)}, {r('i / max(i) OVER ()', 'relative', 5)} FROM g"))
def importance_shares(spark, sf_dir):
    got = _importance(spark, sf_dir).withColumn("horizon", F.lit(2))
    return rounded(bd.importance_shares(got, ["horizon"], "resource").drop("horizon"), 6, {"share_pct": 4, "relative": 5})


_CELLS = """, sv AS (SELECT container_id, stddev_samp(cpu) / nullif(avg(cpu), 0) AS cv FROM grid GROUP BY 1),
ce AS (SELECT horizon, container_id, round(cv, 9) AS cv, (avg(abs(y_true - y_pred)) < avg(abs(y_true - y_naive)))::INT AS won FROM fc JOIN sv USING (container_id) WHERE model = 'mean24' GROUP BY ALL),
rk AS (SELECT *, rank() OVER (PARTITION BY horizon ORDER BY cv) + (count(*) OVER (PARTITION BY horizon, cv) - 1) / 2 AS rk, row_number() OVER (PARTITION BY horizon ORDER BY container_id) AS place FROM ce),
ow AS (SELECT horizon, count(*) AS n, sum(won) AS pos, coalesce(sum(rk) FILTER (won = 1), 0) AS s FROM rk GROUP BY 1),
dr AS (SELECT horizon, rk, replicate, row_number() OVER (PARTITION BY horizon, replicate ORDER BY ('0x' || substr(md5(container_id || '/' || replicate), 1, 8))::BIGINT, container_id) AS place FROM rk, range(1, 201) AS x(replicate)),
su AS (SELECT horizon, replicate, coalesce(sum(dr.rk) FILTER (won = 1), 0) AS d FROM dr JOIN (SELECT horizon, place, won FROM rk) USING (horizon, place) GROUP BY 1, 2),
re AS (SELECT horizon, sum((d >= s)::INT) AS reached FROM su JOIN ow USING (horizon) GROUP BY 1)"""


@query("permutation_p", sql(LONG + _CELLS, f"SELECT horizon::BIGINT AS horizon, n::BIGINT AS n, pos::BIGINT AS pos, {r('(s - pos * (pos + 1) / 2) / nullif((pos * (n - pos))::DOUBLE, 0)', 'auc', D)}, {r('(reached + 1) / 201.0::DOUBLE', 'p', D)}, {r('reached / 200.0::DOUBLE', 'p_plain', D)} FROM ow JOIN re USING (horizon)"))
def permutation_p(spark, sf_dir):
    """Whether a series' coefficient of variation tells where the daily mean beats persistence, against shuffled labels."""
    return rounded(bd.permutation_p(_cells(spark, sf_dir), ["horizon"], "cv", "won", "container_id"), D)


def _cells(spark, sf_dir):
    """Each series' coefficient of variation and, for each horizon, whether the daily mean beats persistence on it."""
    from ..sources.panel import CPU

    cv = grid(spark, sf_dir).groupBy("container_id").agg(ratio(F.stddev_samp(CPU), F.avg(CPU)).alias("cv")).withColumn("cv", round_to(F.col("cv"), 9))
    err = lambda p: F.avg(F.abs(F.col("y_true") - F.col(p)))
    rows = long_forecasts(wide(spark, sf_dir), ("mean24",)).groupBy("horizon", "container_id").agg((err("y_pred") < err("y_naive")).cast("int").alias("won"))
    return materialise(rows.join(cv, "container_id"), "cells")  # a row for each series and horizon, read by several branches


def _thresholds() -> list[float]:
    out, term = [], 0.36787944117144233
    for k in range(1, 7):
        out.append((out[-1] if out else 0.0) + term)
        term /= k
    return out


_U = "('0x' || substr(md5(container_id || '/' || replicate), 1, 8))::BIGINT / 4294967296.0::DOUBLE"
_BW = f""", bs AS (SELECT horizon, container_id, sum((seasonal - mean24) * (y_true - mean24)) AS top, sum((seasonal - mean24) * (seasonal - mean24)) AS bottom FROM wide GROUP BY 1, 2),
bd AS (SELECT *, {' + '.join(f'({_U} >= {t!r})::INT' for t in _thresholds())} AS c FROM bs, range(1, 201) AS x(replicate)),
bf AS (SELECT horizon, greatest(0.0, least(1.0, coalesce(sum(c * top) / nullif(sum(c * bottom), 0), 0.5))) AS w FROM bd GROUP BY horizon, replicate)"""


@query("bootstrap_weights", sql(WIDE + _BW, f"SELECT horizon::BIGINT AS horizon, {r('avg(w)', 'mean', 7)}, {r('stddev_samp(w)', 'std', 7)}, {r('avg((w < 1e-6)::INT)', 'zero_share', 7)}, {r('min(w)', 'least', 7)}, {r('max(w)', 'most', 7)} FROM bf GROUP BY 1"))
def bootstrap_weights(spark, sf_dir):
    return rounded(bd.bootstrap_weights(wide(spark, sf_dir), ("seasonal", "mean24"), ["horizon"]), 7)


def _horner(coefficients: tuple[float, ...], x: str) -> str:
    out = repr(coefficients[0]) + "::DOUBLE"
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c!r}::DOUBLE)"
    return out


_TAILS = f"{_horner(INVERSE_TAIL[0], 't')} / {_horner(INVERSE_TAIL[1], 't')}"
_PHI = "CASE WHEN {z} >= 0 THEN 1 - {u} ELSE {u} END"
_UP = "exp(-{z} * {z} / 2) / sqrt(2 * pi()) * (0.31938153 * k - 0.356563782 * pow(k, 2) + 1.781477937 * pow(k, 3) - 1.821255978 * pow(k, 4) + 1.330274429 * pow(k, 5))"
_BCA = f""", cl AS (SELECT horizon, cv, sum(won) AS p, sum(1 - won) AS q FROM ce GROUP BY 1, 2),
tot AS (SELECT horizon, sum(won) AS pos, sum(1 - won) AS neg FROM ce GROUP BY 1),
lv AS (SELECT a.horizon, a.p, a.q, pos, neg, coalesce(sum(b.q) FILTER (b.cv < a.cv), 0) + a.q / 2.0::DOUBLE AS below, coalesce(sum(b.p) FILTER (b.cv > a.cv), 0) + a.p / 2.0::DOUBLE AS above FROM cl a JOIN cl b USING (horizon) JOIN tot USING (horizon) GROUP BY a.horizon, a.cv, a.p, a.q, pos, neg),
us AS (SELECT horizon, sum(p * below) AS u FROM lv GROUP BY 1),
jk AS (SELECT horizon, p AS m, (u - below) / nullif((pos - 1) * neg, 0) AS j FROM lv JOIN us USING (horizon) UNION ALL SELECT horizon, q, (u - above) / nullif(pos * (neg - 1), 0) FROM lv JOIN us USING (horizon)),
jm AS (SELECT horizon, sum(m * j) / nullif(sum(m) FILTER (j IS NOT NULL), 0) AS mid FROM jk GROUP BY 1),
ac AS (SELECT horizon, coalesce(sum(m * pow(mid - j, 3)) / nullif(6 * pow(sum(m * pow(mid - j, 2)), 1.5), 0), 0) AS acceleration FROM jk JOIN jm USING (horizon) GROUP BY 1),
dw AS (SELECT horizon, cv, won, replicate, {' + '.join(f'({_U} >= {t!r})::INT' for t in _thresholds())} AS c FROM ce, range(1, 201) AS x(replicate)),
dl AS (SELECT horizon, replicate, cv, sum(c * won) AS p, sum(c * (1 - won)) AS q FROM dw GROUP BY ALL),
dc AS (SELECT *, sum(q) OVER (PARTITION BY horizon, replicate ORDER BY cv) - q / 2.0::DOUBLE AS below FROM dl),
bo AS (SELECT horizon, sum(p * below) / nullif((sum(p) * sum(q))::DOUBLE, 0) AS b FROM dc GROUP BY horizon, replicate),
bl AS (SELECT horizon, list_sort(list(b)) AS boot FROM bo WHERE b IS NOT NULL GROUP BY 1),
ob AS (SELECT horizon, pos + neg AS n, pos, u / nullif((pos * neg)::DOUBLE, 0) AS auc, acceleration, boot FROM tot JOIN us USING (horizon) JOIN ac USING (horizon) LEFT JOIN bl USING (horizon)),
sh AS (SELECT *, CASE WHEN boot IS NOT NULL THEN greatest(1e-6, least(1 - 1e-6, len(list_filter(boot, lambda b: b < auc)) / len(boot)::DOUBLE)) END AS f FROM ob),
zq AS (SELECT *, f - 0.5::DOUBLE AS m, (f - 0.5::DOUBLE) * (f - 0.5::DOUBLE) AS mm, sqrt(-2 * ln(least(f, 1 - f))) AS t FROM sh),
zz AS (SELECT *, CASE WHEN least(f, 1 - f) >= {INVERSE_TAIL_FROM} THEN {_horner(INVERSE_MIDDLE[0], 'mm')} * m / {_horner(INVERSE_MIDDLE[1], 'mm')} WHEN f < 0.5 THEN {_TAILS} ELSE -({_TAILS}) END AS z0 FROM zq),
zb AS (SELECT *, z0 + (z0 + s) / (1 - acceleration * (z0 + s)) AS z, side FROM zz, (VALUES ('lo', -1.959963984540054::DOUBLE), ('hi', 1.959963984540054::DOUBLE)) AS v(side, s)),
zk AS (SELECT *, 1 / (1 + 0.2316419 * abs(z)) AS k FROM zb),
za AS (SELECT *, (len(boot) - 1) * ({_PHI.format(z='z', u=_UP.format(z='z'))}) AS place FROM zk),
zl AS (SELECT *, boot[floor(place)::INT + 1] + (place - floor(place)) * (boot[least(floor(place)::INT + 2, len(boot))] - boot[floor(place)::INT + 1]) AS x FROM za)"""


_BCA_QUERY = sql(LONG + _CELLS + _BCA, f"SELECT horizon::BIGINT AS horizon, n::BIGINT AS n, pos::BIGINT AS pos, {r('any_value(auc)', 'auc')}, {r('any_value(z0)', 'z0')}, {r('any_value(acceleration) FILTER (boot IS NOT NULL)', 'acceleration')}, {r('max(x) FILTER (side = $$lo$$)', 'lo', 5)}, {r('max(x) FILTER (side = $$hi$$)', 'hi', 5)} FROM zl GROUP BY horizon, n, pos").replace("$$", "'")


@query("auc_bca_ci", _BCA_QUERY)
def auc_bca_ci(spark, sf_dir):
    """Interval of the AUC of a series' coefficient of variation for where the daily mean beats persistence, over 200 replicates."""
    return rounded(bd.auc_bca(_cells(spark, sf_dir), ["horizon"], "cv", "won", "container_id", 200), 6, {"lo": 5, "hi": 5})


_DRAWS = """st AS (SELECT horizon, container_id, cv, won, row_number() OVER (PARTITION BY horizon, won ORDER BY container_id) AS place, count(*) OVER (PARTITION BY horizon, won) AS m FROM ce),
sp AS (SELECT horizon, won, replicate, 1 + floor(""" + _U + """ * m)::BIGINT AS place FROM st, range(1, 201) AS x(replicate)),
dl AS (SELECT sp.horizon, replicate, cv, sum(won) AS p, sum(1 - won) AS q FROM sp JOIN st USING (horizon, won, place) GROUP BY ALL),
"""
_SKEW = "CASE WHEN boot IS NOT NULL THEN coalesce(list_sum(list_transform(boot, lambda b: pow(list_avg(boot) - b, 3))) / nullif(6 * pow(list_sum(list_transform(boot, lambda b: pow(list_avg(boot) - b, 2))), 1.5), 0), 0) END"
_STRATIFIED = _BCA[: _BCA.index("dw AS (")] + _DRAWS + _BCA[_BCA.index("dc AS (") :]
_STRATIFIED = _STRATIFIED.replace("AS auc, acceleration, boot FROM tot JOIN us USING (horizon) JOIN ac USING (horizon)", f"AS auc, {_SKEW} AS acceleration, boot FROM tot JOIN us USING (horizon)")
_STRATIFIED = _STRATIFIED.replace("greatest(1e-6, least(1 - 1e-6,", "greatest(1 / (2.0::DOUBLE * len(boot)), least(1 - 1 / (2.0::DOUBLE * len(boot)),")


@query("auc_bca_stratified", _BCA_QUERY.replace(_BCA, _STRATIFIED))
def auc_bca_stratified(spark, sf_dir):
    """The same interval with classes drawn apart and the acceleration from the replicates' skewness."""
    return rounded(bd.auc_bca_stratified(_cells(spark, sf_dir), ["horizon"], "cv", "won", "container_id", 200), 6, {"lo": 5, "hi": 5})

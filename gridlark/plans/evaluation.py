"""Queries: forecasts, combinations, scores, tests, intervals."""

from __future__ import annotations

from itertools import combinations
from statistics import NormalDist

from pyspark.sql import functions as F

from ..functions.expressions import r2 as r2_of
from ..operators import evaluate as ev
from ..operators import features as ft
from ..operators import forecast as fc
from ..operators import intervals as iv
from ..operators import predictability as pr
from ..operators.prepare import temporal_split
from ..registry import query
from ..sources.panel import CPU
from .fixtures import GRID, HORIZONS, LONG, PER_DAY, R2, WIDE, chi2_above, grid, long, phi_exact, r, rounded, runs, t_above, t_beyond, wide

MODELS = list(fc.MODELS)
D = 8


def sql(prefix: str, rest: str) -> str:
    return f"WITH {prefix} {rest}"


def r2(p: str) -> str:
    return R2.format(p=p)


_METRICS = f"count(*)::BIGINT AS n, {r(r2('y_pred'), 'r2', D)}, {r('avg(abs(y_true - y_pred))', 'mae', D)}, {r('sqrt(avg((y_true - y_pred) * (y_true - y_pred)))', 'rmse', D)}"


@query("naive_forecast_metrics", sql(LONG, f"SELECT horizon::BIGINT AS horizon, {_METRICS} FROM fc WHERE model = 'persistence' GROUP BY 1"))
def naive_forecast_metrics(spark, sf_dir):
    return rounded(ev.forecast_metrics(fc.long_forecasts(wide(spark, sf_dir), ("persistence",)), ["horizon"]), D)


@query("naive_forecast", sql(WIDE, f"SELECT container_id, time_stamp, horizon::BIGINT AS horizon, {r('y_true', 'y_true')}, {r('y_naive', 'y_pred')} FROM wide"))
def naive_forecast(spark, sf_dir):
    w = wide(spark, sf_dir)
    return rounded(w.select("container_id", "time_stamp", "horizon", "y_true", F.col("persistence").alias("y_pred")))


@query("seasonal_naive", sql(LONG, f"SELECT horizon::BIGINT AS horizon, {_METRICS} FROM fc WHERE model = 'seasonal' GROUP BY 1"))
def seasonal_naive(spark, sf_dir):
    return rounded(ev.forecast_metrics(fc.long_forecasts(wide(spark, sf_dir), ("seasonal",)), ["horizon"]), D)


@query("forecast_metrics", sql(LONG, f"SELECT horizon::BIGINT AS horizon, model, {_METRICS} FROM fc GROUP BY 1, 2"))
def forecast_metrics(spark, sf_dir):
    return rounded(ev.forecast_metrics(long(spark, sf_dir), ["horizon", "model"]), D)


_SERIES_R2 = f", sr AS (SELECT container_id, horizon, model, count(*) AS n, {r2('y_pred')} AS r2_model, {r2('y_naive')} AS r2_naive FROM fc GROUP BY 1, 2, 3)"


@query("series_r2", sql(LONG + _SERIES_R2, f"SELECT container_id, horizon::BIGINT AS horizon, model, n::BIGINT AS n, {r('r2_model', 'r2_model')}, {r('r2_naive', 'r2_naive')}, {r('100 * (r2_model - r2_naive)', 'delta_pp')}, CASE WHEN n < 2 THEN 'too_few_points' WHEN r2_model IS NULL THEN 'constant_y_true' END AS note FROM sr"))
def series_r2(spark, sf_dir):
    return rounded(ev.series_r2(long(spark, sf_dir)))


_SAME, _LARGE = "(sign(y_true - y_naive) = sign(y_pred - y_naive))::INT", "abs(y_true - y_naive) / (y_naive + 1e-8) > 0.01"


@query("directional_accuracy", sql(LONG, f"SELECT horizon::BIGINT AS horizon, model, {r(f'avg({_SAME})', 'da', D)}, {r(f'avg(CASE WHEN {_LARGE} THEN {_SAME} END)', 'da_large', D)}, {r(f'avg(({_LARGE})::INT)', 'large_share', D)} FROM fc GROUP BY 1, 2"))
def directional_accuracy(spark, sf_dir):
    return rounded(ev.directional_accuracy(long(spark, sf_dir), ["horizon", "model"]), D)


@query("mda", sql(LONG, f"SELECT horizon::BIGINT AS horizon, model, {r(f'avg({_SAME})', 'mda', D)}, {r(f'avg(CASE WHEN y_true <> y_naive THEN {_SAME} END)', 'mda_changed', D)}, {r('avg((y_true = y_naive)::INT)', 'zero_share', D)} FROM fc GROUP BY 1, 2"))
def mda(spark, sf_dir):
    return rounded(ev.mda(long(spark, sf_dir), ["horizon", "model"]), D)


@query("zero_change_filter", sql(WIDE, f"SELECT horizon::BIGINT AS horizon, count(*) FILTER (y_true <> y_naive)::BIGINT AS n_changed, {r('avg((y_true = y_naive)::INT)', 'zero_share', D)} FROM wide GROUP BY 1"))
def zero_change_filter(spark, sf_dir):
    changed = F.col("y_true") != F.col("y_naive")
    return rounded(wide(spark, sf_dir).groupBy("horizon").agg(F.count_if(changed).alias("n_changed"), F.avg((~changed).cast("double")).alias("zero_share")), D)


_DEN = f", den AS (SELECT container_id, avg(change) AS d FROM (SELECT container_id, cpu, abs(cpu - lag(cpu, {PER_DAY}) OVER (PARTITION BY container_id ORDER BY time_stamp)) AS change FROM grid) GROUP BY 1 HAVING count(cpu) = count(*) AND count(*) > {PER_DAY} AND avg(change) >= 1e-10)"


@query("mase", sql(LONG + _DEN, f", e AS (SELECT horizon, model, container_id, avg(abs(y_true - y_pred)) AS mae FROM fc GROUP BY 1, 2, 3 HAVING count(*) >= 3), m AS (SELECT horizon, model, mae / d AS mase FROM e JOIN den USING (container_id)) SELECT horizon::BIGINT AS horizon, model, count(*)::BIGINT AS n_series, {r('median(mase)', 'median_mase', D)}, {r('avg(mase)', 'mean_mase', D)} FROM m GROUP BY 1, 2"))
def mase(spark, sf_dir):
    return rounded(ev.mase(long(spark, sf_dir), ft.mase_denominator(grid(spark, sf_dir), PER_DAY), ["horizon", "model"]), D)


@query("skill_and_winrate", sql(LONG, f", s AS (SELECT horizon, model, avg(abs(y_true - y_pred)) AS a, avg(abs(y_true - y_naive)) AS b, avg((abs(y_true - y_pred) < abs(y_true - y_naive))::INT) AS w FROM fc GROUP BY 1, 2) SELECT horizon::BIGINT AS horizon, model, {r('a', 'mae_model', D)}, {r('b', 'mae_naive', D)}, {r('w', 'step_winrate', D)}, {r('1 - a / (b + 1e-9)', 'skill', D)} FROM s"))
def skill_and_winrate(spark, sf_dir):
    return rounded(ev.skill_and_winrate(long(spark, sf_dir), ["horizon", "model"]), D)


_ERR = ", err AS (SELECT horizon, model, container_id, count(*) AS n, avg(abs(y_true - y_pred)) AS mae_model, avg(abs(y_true - y_naive)) AS mae_naive, 1 - avg(abs(y_true - y_pred)) / (avg(abs(y_true - y_naive)) + 1e-9) AS skill, (avg(abs(y_true - y_pred)) < avg(abs(y_true - y_naive)))::INT AS won FROM fc GROUP BY 1, 2, 3 HAVING count(*) >= 5)"
_NOT_NAIVE = "model <> 'persistence'"


#: Columns of ``forecast_columns`` that hold the models' forecasts.
_COLUMNS = {"persistence": CPU, "seasonal": "s_{h}", "mean6": "mean6", "mean24": "mean24"}


def _columns(spark, sf_dir):
    return fc.forecast_columns(grid(spark, sf_dir), HORIZONS, PER_DAY)


def _models(spark, sf_dir):
    """Forecasts of all models but the naive one itself, whose errors equal its own."""
    return fc.long_forecasts(wide(spark, sf_dir), tuple(m for m in MODELS if m != "persistence"))


@query("series_winrate", sql(LONG + _ERR, f"SELECT horizon::BIGINT AS horizon, model, count(*)::BIGINT AS n_series, {r('100 * avg(won)', 'win_pct', D)} FROM err WHERE {_NOT_NAIVE} GROUP BY 1, 2"))
def series_winrate(spark, sf_dir):
    return rounded(ev.series_winrate(_models(spark, sf_dir)), D)


_CV = ", cvs AS (SELECT container_id, CASE WHEN count(cpu) >= 2 AND avg(cpu) >= 1e-6 THEN stddev_samp(cpu) / nullif(avg(cpu), 0) END AS cv FROM grid GROUP BY 1)"


@query("cv_stratified_skill", sql(LONG + _ERR + _CV, f", b AS (SELECT *, CASE WHEN cv < .1 THEN '[0,.1)' WHEN cv < .3 THEN '[.1,.3)' WHEN cv < .5 THEN '[.3,.5)' WHEN cv < .7 THEN '[.5,.7)' ELSE '[.7,inf)' END AS cv_bin FROM err JOIN cvs USING (container_id) WHERE cv IS NOT NULL AND {_NOT_NAIVE}) SELECT horizon::BIGINT AS horizon, model, cv_bin, count(*)::BIGINT AS n, {r('avg(mae_model)', 'mae_model', D)}, {r('avg(mae_naive)', 'mae_naive', D)}, {r('100 * avg(won)', 'win_pct', D)}, {r('1 - avg(mae_model) / (avg(mae_naive) + 1e-9)', 'skill', D)} FROM b GROUP BY 1, 2, 3"))
def cv_stratified_skill(spark, sf_dir):
    return rounded(ev.cv_stratified_skill(_models(spark, sf_dir), pr.series_cv(grid(spark, sf_dir), CPU)), D)


@query("cv_stratified_wins", sql(LONG + _ERR + _CV, f""", b AS (SELECT *, mae_naive - mae_model AS gain, CASE WHEN cv > 0 AND cv <= .3 THEN '(0,.3]' WHEN cv > .3 AND cv <= .7 THEN '(.3,.7]' WHEN cv > .7 THEN '(.7,inf)' END AS cv_class FROM err JOIN cvs USING (container_id) WHERE {_NOT_NAIVE}),
k AS (SELECT *, rank() OVER (PARTITION BY horizon, model, cv_class, gain <> 0 ORDER BY abs(gain)) + (count(*) OVER (PARTITION BY horizon, model, cv_class, gain <> 0, abs(gain)) - 1) / 2 AS rk FROM b WHERE cv_class IS NOT NULL),
s AS (SELECT horizon, model, cv_class, count(*) AS n, 100 * avg(won) AS win_pct, median(skill) AS median_skill, count(*) FILTER (gain <> 0) AS m, coalesce(sum(rk) FILTER (gain > 0), 0) AS w, avg(sign(gain)) AS cliffs_delta FROM k GROUP BY 1, 2, 3 HAVING count(*) >= 5)
SELECT horizon::BIGINT AS horizon, model, cv_class, n::BIGINT AS n, {r('win_pct', 'win_pct', D)}, {r('median_skill', 'median_skill', D)}, m::BIGINT AS m, {r('cliffs_delta', 'cliffs_delta', D)}, {r('CASE WHEN m >= 10 THEN (w - m * (m + 1) / 4) / sqrt(m * (m + 1) * (2 * m + 1) / 24.0) END', 'wilcoxon_z', D)} FROM s"""))
def cv_stratified_wins(spark, sf_dir):
    return rounded(ev.cv_stratified_wins(_models(spark, sf_dir), pr.series_cv(grid(spark, sf_dir), CPU)), D)


def _corr(a: str, b: str) -> str:
    return f"covar_samp({a}, {b}) / nullif(stddev_samp({a}) * stddev_samp({b}), 0)"


_PAIRS = ev.pairs(MODELS)
_CORRS = " UNION ALL ".join(f"SELECT horizon::BIGINT AS horizon, count(*)::BIGINT AS n, '{a}' AS model_a, '{b}' AS model_b, {_corr(f'{a} - y_true', f'{b} - y_true')} AS ec, {_corr(a, b)} AS pc FROM wide GROUP BY 1" for a, b in _PAIRS)


@query("error_correlation", sql(WIDE, f", c AS ({_CORRS}) SELECT horizon, n, model_a, model_b, {r('ec', 'error_corr', D)}, {r('pc', 'pred_corr', D)} FROM c"))
def error_correlation(spark, sf_dir):
    return rounded(ev.error_correlation(wide(spark, sf_dir), MODELS), D)


@query("combination_diagnostics", sql(LONG, f", c AS ({_CORRS}), m AS (SELECT horizon, model, {r2('y_pred')} AS r2, avg(abs(y_true - y_pred)) AS mae FROM fc GROUP BY 1, 2), s AS (SELECT horizon::BIGINT AS horizon, 100 * (max(r2) - min(r2)) AS a, max(mae) - min(mae) AS b, first(model ORDER BY r2 DESC, model) AS best FROM m GROUP BY 1) SELECT horizon, {r('a', 'r2_spread_pp', D)}, {r('b', 'mae_spread', D)}, best, {r('(SELECT avg(ec) FROM c WHERE c.horizon = s.horizon)', 'mean_error_corr', D)} FROM s"))
def combination_diagnostics(spark, sf_dir):
    return rounded(ev.combination_diagnostics(long(spark, sf_dir), ev.error_correlation(wide(spark, sf_dir), MODELS)), D)


_F = "(" + " + ".join(MODELS) + f") / {len(MODELS)}"
_EBAR = "(" + " + ".join(f"({m} - y_true) * ({m} - y_true)" for m in MODELS) + f") / {len(MODELS)}"
_AMB = "(" + " + ".join(f"({m} - {_F}) * ({m} - {_F})" for m in MODELS) + f") / {len(MODELS)}"


@query("ambiguity_decomposition", sql(WIDE, f", a AS (SELECT horizon::BIGINT AS horizon, avg(({_F} - y_true) * ({_F} - y_true)) AS e, avg({_EBAR}) AS e_bar, avg({_AMB}) AS amb FROM wide GROUP BY 1) SELECT horizon, {r('e', 'e', D)}, {r('e_bar', 'e_bar', D)}, {r('amb', 'ambiguity', D)}, {r('e - (e_bar - amb)', 'gap', D)}, {r('amb / nullif(e_bar, 0)', 'ratio', D)} FROM a"))
def ambiguity_decomposition(spark, sf_dir):
    return rounded(ev.ambiguity_decomposition(wide(spark, sf_dir), MODELS), D)


_PHI = "(CASE WHEN {z} >= 0 THEN 1 - {t} ELSE {t} END)"
_POLY = "exp(-({z}) * ({z}) / 2) / 2.5066282746310002 * (0.319381530 * {k} - 0.356563782 * pow({k}, 2) + 1.781477937 * pow({k}, 3) - 1.821255978 * pow({k}, 4) + 1.330274429 * pow({k}, 5))"


def phi(z: str) -> str:
    return _PHI.format(z=f"({z})", t=_POLY.format(z=z, k=f"(1 / (1 + 0.2316419 * abs({z})))"))


_DSQ, _DAB = "(y_true - y_naive) * (y_true - y_naive) - (y_true - y_pred) * (y_true - y_pred)", "abs(y_true - y_naive) - abs(y_true - y_pred)"


@query("paired_ttest", sql(LONG, f", t AS (SELECT horizon, model, count(*) AS n, avg({_DSQ}) / nullif(stddev_samp({_DSQ}) / sqrt(count(*)), 0) AS a, avg({_DAB}) / nullif(stddev_samp({_DAB}) / sqrt(count(*)), 0) AS b FROM fc WHERE {_NOT_NAIVE} GROUP BY 1, 2) SELECT horizon::BIGINT AS horizon, model, n::BIGINT AS n, {r('a', 't_sq', 6)}, {r('b', 't_abs', 6)}, {r(f'coalesce({t_above("a", "(n - 1)")}, 1)', 'p_sq', 6)}, {r(f'coalesce({t_above("b", "(n - 1)")}, 1)', 'p_abs', 6)} FROM t"))
def paired_ttest(spark, sf_dir):
    return rounded(ev.paired_ttest(_models(spark, sf_dir), ["horizon", "model"]))


_MAXLAG = max(HORIZONS) - 1
_SW = "PARTITION BY horizon, model, container_id ORDER BY time_stamp"
_DM = f""", dd AS (SELECT horizon, model, container_id, time_stamp, (y_true - y_pred) * (y_true - y_pred) - (y_true - y_naive) * (y_true - y_naive) AS d FROM fc WHERE {_NOT_NAIVE}),
dc AS (SELECT *, d - avg(d) OVER (PARTITION BY horizon, model) AS c FROM dd),
dg AS (SELECT horizon, model, d, c, {', '.join(f'c * lag(c, {k}) OVER ({_SW}) AS g{k}' for k in range(1, _MAXLAG + 1))} FROM dc),
dm AS (SELECT horizon, model, count(*) AS n, avg(d) AS mean_d, avg(c * c) AS g0, {', '.join(f'coalesce(avg(g{k}), 0) AS g{k}' for k in range(1, _MAXLAG + 1))} FROM dg GROUP BY 1, 2),
ds AS (SELECT *, g0 + {' + '.join(f'CASE WHEN least(greatest(horizon - 1, 1), n // 4) >= {k} THEN 2 * g{k} ELSE 0 END' for k in range(1, _MAXLAG + 1))} AS v FROM dm),
dr AS (SELECT horizon, model, n, mean_d / sqrt(greatest(v / n, 1e-12)) * sqrt((n + 1 - 2 * horizon + horizon * (horizon - 1) / n) / n) AS dm FROM ds)"""


@query("dm_test", sql(LONG + _DM, f"SELECT horizon::BIGINT AS horizon, model, n::BIGINT AS n, {r('dm', 'dm', 6)}, {r(t_beyond('dm', '(n - 1)'), 'p_two', 6)}, {r(t_above('-dm', '(n - 1)'), 'p_one', 6)}, CASE WHEN n < 3 THEN 'too_few_points' END AS note FROM dr"))
def dm_test(spark, sf_dir):
    models = {m: c for m, c in _COLUMNS.items() if m != "persistence"}
    return rounded(ev.dm_of(ev.panel_autocovariances(_columns(spark, sf_dir), HORIZONS, models, CPU, ev.loss_difference, _MAXLAG), _MAXLAG))


_DMP = " UNION ALL ".join(f"SELECT horizon, count(*) AS n, '{a}' AS model_a, '{b}' AS model_b, avg(abs({a} - y_true) - abs({b} - y_true)) AS m, var_pop(abs({a} - y_true) - abs({b} - y_true)) AS v FROM wide GROUP BY 1" for a, b in _PAIRS)
_DMM = f""", q AS ({_DMP}), d AS (SELECT *, CASE WHEN v > 0 THEN m / sqrt(v / n) * sqrt((n - 1) / n) END AS dm FROM q WHERE n >= 30), p AS (SELECT *, 2 * (1 - {phi('abs(dm)')}) AS p FROM d),
k AS (SELECT *, (count(p) OVER (PARTITION BY horizon) - row_number() OVER (PARTITION BY horizon ORDER BY p NULLS LAST, model_a, model_b) + 1) * p AS scaled FROM p)"""


@query("dm_matrix", sql(WIDE + _DMM, f"SELECT horizon::BIGINT AS horizon, n::BIGINT AS n, model_a, model_b, {r('dm', 'dm', 6)}, {r('p', 'p', 6)}, {r('least(1, max(scaled) OVER (PARTITION BY horizon ORDER BY p NULLS LAST, model_a, model_b ROWS UNBOUNDED PRECEDING))', 'p_holm', 6)} FROM k"))
def dm_matrix(spark, sf_dir):
    return rounded(ev.dm_matrix(wide(spark, sf_dir), MODELS))


_FR = """, fe AS (SELECT horizon, container_id, model, avg(abs(y_true - y_pred)) AS mae FROM fc GROUP BY 1, 2, 3 HAVING count(*) >= 10),
ff AS (SELECT * FROM fe QUALIFY count(*) OVER (PARTITION BY horizon, container_id) = 4),
fk AS (SELECT *, count(*) OVER (PARTITION BY horizon, container_id, mae) AS ties, rank() OVER (PARTITION BY horizon, container_id ORDER BY mae) + (count(*) OVER (PARTITION BY horizon, container_id, mae) - 1) / 2 AS rk FROM ff),
fm AS (SELECT horizon, model, avg(rk) AS mean_rank, count(*) AS n, sum(ties * ties - 1) AS t FROM fk GROUP BY 1, 2),
fr AS (SELECT horizon::BIGINT AS horizon, model, mean_rank, n::BIGINT AS n_series, (12 * n / 20.0 * (sum(mean_rank * mean_rank) OVER (PARTITION BY horizon) - 25.0)) / nullif(1 - sum(t) OVER (PARTITION BY horizon) / (n * 60), 0) AS chi2 FROM fm WHERE n >= 10)"""


@query("friedman_ranks", sql(LONG + _FR, f"SELECT horizon, model, {r('mean_rank', 'mean_rank', 7)}, n_series, {r('chi2', 'chi2', 5)}, {r(chi2_above('chi2', len(MODELS) - 1), 'p', 7)} FROM fr"))
def friedman_ranks(spark, sf_dir):
    return rounded(ev.friedman_ranks(long(spark, sf_dir)), 7, {"chi2": 5})


_RANGE = f"""greatest(0, 1 - {len(MODELS)} * 0.2 / sqrt(2 * pi()) * (SELECT sum(exp(-x.z * x.z / 2) * pow(greatest({phi_exact('x.z')} - {phi_exact('(x.z - q)')}, 0), {len(MODELS) - 1})) FROM (SELECT -9 + 0.2 * i AS z FROM range(91) AS y(i)) x))"""
_PAIRED = ", np AS (SELECT a.horizon, a.model AS model_a, b.model AS model_b, abs(a.mean_rank - b.mean_rank) AS diff, sqrt(20 / (6.0 * a.n_series)) AS err, abs(a.mean_rank - b.mean_rank) / sqrt(20 / (6.0 * a.n_series)) * sqrt(2) AS q FROM fr a JOIN fr b ON a.horizon = b.horizon AND a.model < b.model)"


@query("nemenyi_pairs", sql(LONG + _FR + _PAIRED, f"SELECT horizon, model_a, model_b, {r('diff', 'diff', 7)}, {r('2.569 * err', 'cd', 7)}, {r(_RANGE, 'p', 7)}, diff > 2.569 * err AS significant FROM np"))
def nemenyi_pairs(spark, sf_dir):
    return rounded(ev.nemenyi_pairs(ev.friedman_ranks(long(spark, sf_dir)), len(MODELS)), 7)


_LB = f""", re AS (SELECT horizon, model, container_id, time_stamp, y_true - y_pred AS e FROM fc), rc AS (SELECT *, e - avg(e) OVER (PARTITION BY horizon, model) AS c FROM re),
rg AS (SELECT horizon, model, e, c, {', '.join(f'c * lag(c, {k}) OVER ({_SW}) AS g{k}' for k in range(1, 11))} FROM rc),
rs AS (SELECT horizon, model, count(*) AS n, avg(e) AS bias, sum(c * c) AS g0, {', '.join(f'sum(g{k}) AS g{k}' for k in range(1, 11))} FROM rg GROUP BY 1, 2)"""
_Q = " + ".join(f"pow(coalesce(g{k} / nullif(g0, 0), 0), 2) / (n - {k})" for k in range(1, 11))


@query("residual_diagnostics", sql(LONG + _LB, f"SELECT horizon::BIGINT AS horizon, model, n::BIGINT AS n, {r('bias', 'bias', 7)}, {r('g1 / nullif(g0, 0)', 'acf1', 7)}, {r(f'n * (n + 2) * ({_Q})', 'ljung_box', 3)}, {r(chi2_above(f'(n * (n + 2) * ({_Q}))', 10), 'ljung_box_p', 7)} FROM rs"))
def residual_diagnostics(spark, sf_dir):
    return rounded(ev.diagnostics_of(ev.panel_autocovariances(_columns(spark, sf_dir), HORIZONS, _COLUMNS, CPU, ev.residual, 10)), 7, {"ljung_box": 3})


@query("residual_histogram", sql(LONG, f", h AS (SELECT horizon, model, floor((y_true - y_pred) / 5)::BIGINT AS bin, count(*)::BIGINT AS n FROM fc GROUP BY ALL) SELECT horizon::BIGINT AS horizon, model, bin, n, {r('n / sum(n) OVER (PARTITION BY horizon, model)', 'share', D)} FROM h"))
def residual_histogram(spark, sf_dir):
    return rounded(ev.residual_histogram(long(spark, sf_dir)), D)


_QQ = f""", qc AS (SELECT horizon, model, floor((y_true - y_pred) * 1000 + 0.5) / 1000 AS e, count(*) AS c FROM fc GROUP BY ALL),
qu AS (SELECT horizon, model, e, sum(c) OVER (PARTITION BY horizon, model ORDER BY e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM qc),
qm AS (SELECT horizon, model, sum(c) AS n, sum(e * c) AS s, sum(e * e * c) AS ss FROM qc GROUP BY ALL),
ql AS (SELECT * FROM (VALUES {', '.join(f'({p}::DOUBLE, {NormalDist().inv_cdf(p)!r}::DOUBLE)' for p in ev.QQ_LEVELS)}) AS v(level, z))"""


@query("residual_qq", sql(LONG + _QQ, f"SELECT horizon::BIGINT AS horizon, model, level, {r('min(e)', 'observed', 3)}, {r('any_value(s / n + z * sqrt(greatest(ss / n - (s / n) * (s / n), 0)))', 'normal', 7)} FROM qu JOIN qm USING (horizon, model), ql WHERE upto >= level * n GROUP BY ALL"))
def residual_qq(spark, sf_dir):
    return rounded(ev.residual_qq(long(spark, sf_dir)), 3, {"normal": 7})


@query("condition_numbers")
def condition_numbers(spark, sf_dir):
    """Condition number of the models' error correlations, for each horizon."""
    return rounded(ev.condition_numbers(ev.error_correlation(wide(spark, sf_dir), MODELS), MODELS), 3)


_ACF24 = ", ac AS (SELECT container_id, covar_samp(x, cpu) / nullif(stddev_samp(CASE WHEN cpu IS NOT NULL THEN x END) * stddev_samp(CASE WHEN x IS NOT NULL THEN cpu END), 0) AS acf FROM (SELECT container_id, cpu, lag(cpu, 24) OVER (PARTITION BY container_id ORDER BY time_stamp) AS x FROM grid) GROUP BY 1)"


def _acf24(spark, sf_dir):
    return ft.acf(grid(spark, sf_dir), (24,)).withColumnRenamed("acf_24", "acf")


@query("rule_auc", sql(LONG + _ERR + _ACF24, f", s AS (SELECT horizon, won, rank() OVER (PARTITION BY horizon ORDER BY acf) + (count(*) OVER (PARTITION BY horizon, acf) - 1) / 2 AS rk FROM err JOIN ac USING (container_id) WHERE model = 'mean24' AND acf IS NOT NULL) SELECT horizon::BIGINT AS horizon, count(*)::BIGINT AS n, sum(won)::BIGINT AS pos, {r('(coalesce(sum(rk) FILTER (won = 1), 0) - sum(won) * (sum(won) + 1) / 2) / nullif((sum(won) * (count(*) - sum(won)))::DOUBLE, 0)', 'auc', D)} FROM s GROUP BY 1"))
def rule_auc(spark, sf_dir):
    e = ev.series_errors(_models(spark, sf_dir).filter("model = 'mean24'")).join(_acf24(spark, sf_dir).filter("acf is not null"), "container_id")
    return rounded(ev.rule_auc(e, ["horizon"], "acf", "won"), D)


@query("acf_quartile_skill", sql(LONG + _ERR + _ACF24, f", q AS (SELECT container_id, ntile(4) OVER (ORDER BY acf, container_id) AS quartile FROM ac WHERE acf IS NOT NULL) SELECT horizon::BIGINT AS horizon, model, quartile::BIGINT AS quartile, count(*)::BIGINT AS n, {r('median(mae_model)', 'median_mae', D)}, {r('median(skill)', 'median_skill', D)}, {r('avg(skill)', 'mean_skill', D)}, {r('100 * avg(won)', 'win_pct', D)} FROM err JOIN q USING (container_id) WHERE {_NOT_NAIVE} GROUP BY 1, 2, 3"))
def acf_quartile_skill(spark, sf_dir):
    return rounded(ev.quartile_skill(_models(spark, sf_dir), _acf24(spark, sf_dir)), D)


_POISSON, _t = [], 0.36787944117144233
for _k in range(1, 7):
    _POISSON.append((_POISSON[-1] if _POISSON else 0.0) + _t)
    _t /= _k
_U = "('0x' || substr(md5(container_id || '/' || replicate), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


@query("metric_bootstrap_ci", sql(LONG, f", s AS (SELECT horizon, model, container_id, sum(abs(y_true - y_pred)) AS e, count(*) AS n FROM fc GROUP BY 1, 2, 3), w AS (SELECT *, {' + '.join(f'({_U} >= {t!r})::INT' for t in _POISSON)} AS w FROM s, range(1, 201) AS x(replicate)), m AS (SELECT horizon, model, replicate, sum(w * e) / nullif(sum(w * n), 0) AS mae FROM w GROUP BY 1, 2, 3) SELECT horizon::BIGINT AS horizon, model, {r('quantile_cont(mae, 0.025)', 'lo', D)}, {r('quantile_cont(mae, 0.975)', 'hi', D)} FROM m GROUP BY 1, 2"))
def metric_bootstrap_ci(spark, sf_dir):
    """Interval of the MAE over 200 replicates, as its SQL has it; ``metric_bootstrap_full`` does the whole job."""
    return rounded(ev.metric_bootstrap(long(spark, sf_dir), 200).select("horizon", "model", "lo", "hi"), D)


_BOUNDS = ", ".join(f"max(CASE WHEN replicate = 0 THEN {c} END) AS {c}, quantile_cont(CASE WHEN replicate > 0 THEN {c} END, 0.025) AS {p}lo, quantile_cont(CASE WHEN replicate > 0 THEN {c} END, 0.975) AS {p}hi" for c, p in (("mae", ""), ("r2", "r2_")))


@query("metric_bootstrap_full", sql(LONG, f", s AS (SELECT horizon, model, container_id, sum(abs(y_true - y_pred)) AS e, sum((y_true - y_pred) * (y_true - y_pred)) AS e2, sum(y_true) AS y, sum(y_true * y_true) AS y2, count(*) AS n FROM fc GROUP BY 1, 2, 3), w AS (SELECT *, CASE WHEN replicate = 0 THEN 1 ELSE {' + '.join(f'({_U} >= {t!r})::INT' for t in _POISSON)} END AS w FROM s, range(0, 1001) AS x(replicate)), t AS (SELECT horizon, model, replicate, sum(w * e) AS e, sum(w * e2) AS e2, sum(w * y) AS y, sum(w * y2) AS y2, sum(w * n)::DOUBLE AS n FROM w GROUP BY 1, 2, 3), m AS (SELECT horizon, model, replicate, e / nullif(n, 0) AS mae, CASE WHEN y2 - y * y / nullif(n, 0) > 1e-12 * y2 THEN 1 - e2 / (y2 - y * y / n) END AS r2 FROM t), b AS (SELECT horizon, model, {_BOUNDS} FROM m GROUP BY 1, 2) SELECT horizon::BIGINT AS horizon, model, {', '.join(r(c, c, D) for c in ('mae', 'lo', 'hi', 'r2', 'r2_lo', 'r2_hi'))} FROM b"))
def metric_bootstrap_full(spark, sf_dir):
    """MAE and R2 with intervals over 1,000 replicates."""
    return rounded(ev.metric_bootstrap(long(spark, sf_dir)), D)


@query("asymmetric_cost", sql(LONG, f", c AS (SELECT horizon, model, ratio, sum(greatest(y_true - y_pred, 0) * ratio + greatest(y_pred - y_true, 0)) * 4e-5 AS a, sum(greatest(y_true - y_naive, 0) * ratio + greatest(y_naive - y_true, 0)) * 4e-5 AS b FROM fc, (VALUES (1), (2), (3), (5), (10)) AS x(ratio) GROUP BY 1, 2, 3) SELECT horizon::BIGINT AS horizon, model, ratio::BIGINT AS ratio, {r('a', 'model_cost')}, {r('b', 'naive_cost')}, {r('100 * (b - a) / nullif(b, 0)', 'savings_pct')} FROM c"))
def asymmetric_cost(spark, sf_dir):
    return rounded(ev.asymmetric_cost(long(spark, sf_dir)))


_SWEEP = f""", sl AS (SELECT cpu / 100 AS demand, {', '.join(f'lag(cpu, {k}) OVER (PARTITION BY container_id ORDER BY time_stamp) / 100 AS d{k}' for k in (1, 2, 3, 4))} FROM grid),
sx AS ({' UNION ALL '.join(f'SELECT demand, {k} AS lag, d{k} AS seen FROM sl WHERE d{k} IS NOT NULL' for k in (1, 2, 3, 4))}),
sc AS (SELECT demand, lag, target, margin, greatest(1, least(100, ceil(round(seen * margin / (0.5::DOUBLE * target), 9)))) * 0.5::DOUBLE AS capacity FROM sx, (VALUES (0.5::DOUBLE), (0.6), (0.7), (0.8)) AS t(target), (VALUES (1.0::DOUBLE), (1.2), (1.4), (1.6)) AS m(margin)),
sw AS (SELECT target, margin, lag::BIGINT AS lag, avg((demand > capacity)::INT) AS violation, sum(greatest(capacity - demand, 0)) / sum(capacity) AS waste, sum(greatest(demand - capacity, 0)) / sum(demand) AS severity FROM sc GROUP BY ALL)"""


@query("scaling_policy_sweep", sql(GRID + _SWEEP, f"SELECT target, margin, lag, {r('violation', 'violation', D)}, {r('waste', 'waste', D)}, {r('severity', 'severity', D)}, {r('0.05 * waste + 0.5 * violation', 'cost_per_hour', D)} FROM sw"))
def scaling_policy_sweep(spark, sf_dir):
    return rounded(ev.scaling_policy_sweep(runs(spark, sf_dir), CPU, points="points"), D)


@query("pareto_front", sql(GRID + _SWEEP, f", pts AS (SELECT DISTINCT lag, {r('violation', 'violation', 7)}, {r('waste', 'waste', 7)} FROM sw), f AS (SELECT *, min(waste) OVER (PARTITION BY lag ORDER BY violation, waste ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low FROM pts) SELECT lag, violation, waste FROM f WHERE low IS NULL OR waste < low"))
def pareto_front(spark, sf_dir):
    pts = rounded(ev.scaling_policy_sweep(runs(spark, sf_dir), CPU, points="points").select("lag", "violation", "waste"), 7)
    return ev.pareto_front(pts, ["lag"], "violation", "waste")


@query("distinct_points", sql(GRID + _SWEEP, f"SELECT lag, count(*)::BIGINT AS n_points, count(DISTINCT ({r('violation', digits=7)}, {r('waste', digits=7)}))::BIGINT AS n_distinct FROM sw GROUP BY 1"))
def distinct_points(spark, sf_dir):
    pts = rounded(ev.scaling_policy_sweep(runs(spark, sf_dir), CPU, points="points").select("lag", "violation", "waste"), 7)
    return pts.groupBy("lag").agg(F.count("*").alias("n_points"), F.countDistinct(F.struct("violation", "waste")).alias("n_distinct"))


_GAUSS = ", gi AS (SELECT cpu AS y_true, avg(cpu) OVER w AS m, stddev_samp(cpu) OVER w AS s, count(cpu) OVER w AS n FROM grid WINDOW w AS (PARTITION BY container_id ORDER BY time_stamp ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)), gb AS (SELECT y_true, round(m - 1.28 * s, 6) AS lower, round(m + 1.28 * s, 6) AS upper FROM gi WHERE n = 24)"
_SCORES = f"{r('100 * avg((y_true BETWEEN lower AND upper)::INT)', 'coverage_pct', 3)}, {r('avg(upper - lower)', 'mean_width', 7)}, {r('median(upper - lower)', 'median_width', 7)}, {r('avg(upper - lower + 10 * greatest(lower - y_true, 0) + 10 * greatest(y_true - upper, 0))', 'interval_score', 7)}, {r('abs(100 * avg((y_true BETWEEN lower AND upper)::INT) - 80)', 'calibration_error', 3)}"


@query("gaussian_interval", sql(GRID + _GAUSS, f"SELECT {_SCORES} FROM gb"))
def gaussian_interval(spark, sf_dir):
    return rounded(iv.interval_scores(iv.gaussian_interval(grid(spark, sf_dir), CPU), []), 7, {"coverage_pct": 3, "calibration_error": 3})


_SPLITC = f""", sp AS (SELECT horizon, model, container_id, abs(y_true - y_pred) AS e, row_number() OVER ({_SW}) * 2 <= count(*) OVER (PARTITION BY horizon, model, container_id) AS early FROM fc),
se AS (SELECT *, row_number() OVER (PARTITION BY horizon, model, container_id ORDER BY e) AS k, count(*) OVER (PARTITION BY horizon, model, container_id) AS n FROM sp WHERE early),
sq AS (SELECT horizon, model, container_id, e AS q FROM se WHERE k = least(ceil(0.8::DOUBLE * (n + 1)), n))"""


@query("split_conformal", sql(LONG + _SPLITC, f"SELECT horizon::BIGINT AS horizon, model, count(*)::BIGINT AS n, {r('avg((e <= q)::INT)', 'coverage', 7)}, {r('avg(2 * q)', 'width', 7)} FROM sp JOIN sq USING (horizon, model, container_id) WHERE NOT early GROUP BY 1, 2"))
def split_conformal(spark, sf_dir):
    rows = fc.forecast_columns(grid(spark, sf_dir), HORIZONS, PER_DAY)
    return rounded(iv.split_conformal_panel(rows, HORIZONS, {"persistence": CPU, "seasonal": "s_{h}", "mean6": "mean6", "mean24": "mean24"}, CPU), 7)


_QW = "PARTITION BY container_id ORDER BY time_stamp ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING"


@query("quantile_forecast_check", sql(GRID, f", q AS (SELECT container_id, cpu AS y_true, count(cpu) OVER w AS n, quantile_cont(cpu, 0.1) OVER w AS p10, quantile_cont(cpu, 0.5) OVER w AS p50, quantile_cont(cpu, 0.9) OVER w AS p90 FROM grid WINDOW w AS ({_QW})) SELECT container_id, {r('avg((y_true BETWEEN p10 AND p90)::INT)', 'coverage', 3)}, {r('avg((p10 < p50 AND p50 < p90)::INT)', 'ordered', 3)}, {r('avg(coalesce(isfinite(p10) AND isfinite(p50) AND isfinite(p90), false)::INT)', 'finite_share', 3)}, {r('avg(p50)', 'mean_p50', 7)}, {r('avg(p90 - p10)', 'width', 7)} FROM q WHERE n = 24 GROUP BY 1"))
def quantile_forecast_check(spark, sf_dir):
    """Rolling quantiles of the last 24 values as a quantile forecast of the next."""
    from pyspark.sql import Window

    w = Window.partitionBy("container_id").orderBy("time_stamp").rowsBetween(-24, -1)
    q = grid(spark, sf_dir).select("container_id", F.col(CPU).alias("y_true"), F.count(CPU).over(w).alias("n"), F.array_sort(F.collect_list(CPU).over(w)).alias("v")).filter("n = 24")
    at = lambda p: F.element_at("v", int(23 * p) + 1) + (23 * p - int(23 * p)) * (F.element_at("v", int(23 * p) + 2) - F.element_at("v", int(23 * p) + 1))
    q = q.withColumns({"p10": at(0.1), "p50": at(0.5), "p90": at(0.9)})
    return rounded(ev.quantile_forecast_check(q, ["container_id"]), 7, {"coverage": 3, "ordered": 3, "finite_share": 3})


_THREE = ("seasonal", "mean6", "mean24")


def _solved(support: tuple[str, ...]) -> list[str]:
    """Least-squares weights of up to three models by Cramer's rule, in the order of _THREE (0 for models left out)."""
    xx = lambda a, b: f"x_{min(a, b)}_{max(a, b)}"
    y = [f"y_{m}" for m in support]
    rows = [[xx(a, b) for b in support] for a in support]

    def det(m: list[list[str]]) -> str:
        if len(m) == 1:
            return m[0][0]
        return "(" + " + ".join(f"{'' if j % 2 == 0 else '-1 * '}{m[0][j]} * {det([row[:j] + row[j + 1 :] for row in m[1:]])}" for j in range(len(m))) + ")"

    w = {m: f"{det([[y[i] if c == j else rows[i][c] for c in range(len(support))] for i in range(len(support))])} / nullif({det(rows)}, 0)" for j, m in enumerate(support)}
    return [w.get(m, "0.0::DOUBLE") for m in _THREE]


_RES = ", ".join(f"{m} - y_naive AS d_{m}" for m in _THREE)
_SUMS = ", ".join([f"sum(d_{a} * d_{b}) AS x_{min(a, b)}_{max(a, b)}" for i, a in enumerate(_THREE) for b in _THREE[i:]] + [f"sum(d_{m} * d_y) AS y_{m}" for m in _THREE])
_SUPPORTS = [s for k in (1, 2, 3) for s in combinations(_THREE, k)]
_NNLS = WIDE + f""", gs AS (SELECT horizon, {_SUMS} FROM (SELECT horizon, {_RES}, y_true - y_naive AS d_y FROM wide) GROUP BY 1),
cand AS ({" UNION ALL ".join(f"SELECT horizon, [{', '.join(repr(m) for m in s)}] AS support, {', '.join(f'{w} AS w_{m}' for m, w in zip(_THREE, _solved(s), strict=True))}, {', '.join(f'y_{m}' for m in _THREE)} FROM gs" for s in _SUPPORTS)}),
good AS (SELECT *, {' + '.join(f'w_{m} * y_{m}' for m in _THREE)} AS gain FROM cand WHERE {' AND '.join(f'w_{m} >= 0' for m in _THREE)}),
best AS (SELECT horizon, left_out, coalesce(arg_max([{', '.join(f'w_{m}' for m in _THREE)}], gain) FILTER (gain > 1e-12), [0.0, 0.0, 0.0]) AS w FROM good, (VALUES ('none'), {', '.join(f'({m!r})' for m in _THREE)}) AS g(left_out) WHERE NOT list_contains(support, left_out) GROUP BY ALL),
nw AS (SELECT horizon, left_out, m.model AS model, CASE WHEN list_sum(w) > 1e-8 THEN w[m.k] / list_sum(w) ELSE CASE WHEN left_out = 'none' THEN 1 / 3.0::DOUBLE ELSE 0.5::DOUBLE END END AS weight
  FROM best, (VALUES {', '.join(f'({m!r}, {k + 1})' for k, m in enumerate(_THREE))}) AS m(model, k) WHERE m.model <> left_out)"""


@query("nnls_combine", f"WITH {_NNLS} SELECT horizon::BIGINT AS horizon, left_out, model, {r('weight', 'weight')} FROM nw WHERE left_out = 'none'")
def nnls_combine(spark, sf_dir):
    """Non-negative weights of three models in residual space, for each horizon."""
    return rounded(fc.nnls_weights(wide(spark, sf_dir), _THREE, ["horizon"]))


_LOO = f""", cw AS (SELECT horizon, left_out, {', '.join(f"coalesce(max(weight) FILTER (model = {m!r}), 0) AS w_{m}" for m in _THREE)} FROM nw GROUP BY ALL),
cp AS (SELECT horizon, left_out, y_true, y_naive + {' + '.join(f'w_{m} * ({m} - y_naive)' for m in _THREE)} AS y_pred FROM wide JOIN cw USING (horizon))"""


@query("loo_combine", f"WITH {_NNLS}{_LOO} SELECT horizon::BIGINT AS horizon, left_out, {r(r2('y_pred'), 'r2')}, {r('avg(abs(y_true - y_pred))', 'mae')} FROM cp GROUP BY 1, 2")
def loo_combine(spark, sf_dir):
    w = fc.nnls_weights(wide(spark, sf_dir), _THREE, ["horizon"], leave_out=True)
    got = fc.combined(wide(spark, sf_dir), w, _THREE, ["horizon"])
    return rounded(got.groupBy("horizon", "left_out").agg(r2_of(F.col("y_true"), F.col("y_pred")).alias("r2"), F.avg(F.abs(F.col("y_true") - F.col("y_pred"))).alias("mae")))


# fitted before the test split of the global clock, scored on it
_SPLIT = WIDE + ", tb AS (SELECT min(time_stamp) + 0.85::DOUBLE * (max(time_stamp) - min(time_stamp)) AS cut FROM wide), tr AS (SELECT * FROM wide WHERE time_stamp < (SELECT cut FROM tb)), te AS (SELECT * FROM wide WHERE time_stamp >= (SELECT cut FROM tb))"
_FITTED = _SPLIT + _NNLS[len(WIDE) :].replace("FROM wide", "FROM tr")
_AT = [f"x_{min(a, b)}_{max(a, b)}" for a in _THREE for b in _THREE]


def _cofactor(i: int, j: int) -> str:
    """Entry of the inverse of the 3 by 3 matrix of sums with the penalty, times its determinant."""
    at = lambda a, b: f"({_AT[3 * a + b]} + {'alpha' if a == b else '0'})"
    p, q = ([k for k in range(3) if k != x] for x in (j, i))
    return f"{'' if (i + j) % 2 == 0 else '-'}({at(p[0], q[0])} * {at(p[1], q[1])} - {at(p[0], q[1])} * {at(p[1], q[0])})"


_DETERMINANT = " + ".join(f"(x_{min(_THREE[0], m)}_{max(_THREE[0], m)} + {'alpha' if j == 0 else '0'}) * ({_cofactor(j, 0)})" for j, m in enumerate(_THREE))
_D3 = [f"({m} - y_naive)" for m in _THREE]
_RIDGE = f""", rd AS (SELECT gs.*, alpha, {_DETERMINANT} AS det FROM gs, (VALUES (0.01::DOUBLE), (0.1), (1.0), (10.0)) AS p(alpha)),
ri AS (SELECT horizon, alpha, {', '.join(f'({_cofactor(i, j)}) / det AS v{i}{j}' for i in range(3) for j in range(3))}, {', '.join(f'y_{m}' for m in _THREE)} FROM rd),
rw AS (SELECT *, {', '.join(f"{' + '.join(f'v{i}{j} * y_{m}' for j, m in enumerate(_THREE))} AS w{i}" for i in range(3))} FROM ri),
rl AS (SELECT horizon, alpha, any_value(w0) AS w0, any_value(w1) AS w1, any_value(w2) AS w2, avg(pow((y_true - y_naive - {' - '.join(f'w{i} * {d}' for i, d in enumerate(_D3))}) / (1 - ({' + '.join(f'v{i}{j} * {a} * {b}' for i, a in enumerate(_D3) for j, b in enumerate(_D3))})), 2)) AS loo FROM tr JOIN rw USING (horizon) GROUP BY 1, 2),
rb AS (SELECT horizon, first(alpha ORDER BY loo, alpha) AS alpha, first([w0, w1, w2] ORDER BY loo, alpha) AS w FROM rl GROUP BY 1),
em AS (SELECT horizon, {', '.join(f'1 / greatest(avg(pow(y_true - {m}, 2)), 1e-12) AS i{k}, avg(abs(y_true - {m})) AS a{k}' for k, m in enumerate(_THREE))} FROM tr GROUP BY 1),
cm AS (SELECT horizon, 'nnls' AS method, 3 AS n_models, NULL::DOUBLE AS alpha, [{', '.join(f"max(weight) FILTER (model = {m!r})" for m in _THREE)}] AS w FROM nw WHERE left_out = 'none' GROUP BY 1
  UNION ALL SELECT horizon, 'simple_average', 3, NULL, [1 / 3.0::DOUBLE, 1 / 3.0::DOUBLE, 1 / 3.0::DOUBLE] FROM em
  UNION ALL SELECT horizon, 'ridge', 3, alpha, w FROM rb
  UNION ALL SELECT horizon, 'bates_granger', 3, NULL, [i0 / (i0 + i1 + i2), i1 / (i0 + i1 + i2), i2 / (i0 + i1 + i2)] FROM em
  UNION ALL SELECT horizon, 'best_individual', 1, NULL, CASE WHEN a0 <= a1 AND a0 <= a2 THEN [1.0, 0.0, 0.0] WHEN a1 <= a2 THEN [0.0, 1.0, 0.0] ELSE [0.0, 0.0, 1.0] END FROM em),
cs AS (SELECT *, CASE WHEN method = 'ridge' AND abs(list_sum(w)) > 1e-8 THEN list_sum(w) ELSE 1 END AS total FROM cm),
ct AS (SELECT horizon, method, n_models, alpha, {" || ' ' || ".join(f"printf('{m}=%.3f', round(w[{k + 1}] / total, 3) + 0.0)" for k, m in enumerate(_THREE))} AS weights, w FROM cs),
cv AS (SELECT ct.horizon, method, n_models, alpha, weights, y_true, y_naive + {' + '.join(f'w[{k + 1}] * {d}' for k, d in enumerate(_D3))} AS y_pred FROM te JOIN ct USING (horizon))"""


@query("combine_methods", f"WITH {_FITTED}{_RIDGE} SELECT horizon::BIGINT AS horizon, method, n_models::BIGINT AS n_models, {r('alpha', 'alpha')}, weights, {r(r2('y_pred'), 'r2')}, {r('avg(abs(y_true - y_pred))', 'mae')} FROM cv GROUP BY ALL")
def combine_methods(spark, sf_dir):
    """Five combinations of three models for each horizon, fitted before the test split and scored on it."""
    rows = temporal_split(wide(spark, sf_dir), (0.85, 0.85))
    return rounded(fc.combine_methods(rows.filter("split = 'train'"), rows.filter("split = 'test'"), tuple(_THREE), ["horizon"]))


_GAP = ", gap AS (SELECT * FROM fc WHERE NOT (model = 'mean24' AND (time_stamp // 3600) % 3 = 0)), gw AS (SELECT horizon, model, 1 / greatest(avg((y_true - y_pred) * (y_true - y_pred)), 1e-12) AS weight FROM fc GROUP BY 1, 2)"


@query("apply_weights", sql(LONG + _GAP, f"SELECT container_id, time_stamp, horizon::BIGINT AS horizon, {r('y_true', 'y_true')}, {r('any_value(y_naive) + coalesce(sum(weight * (y_pred - y_naive)) / nullif(sum(weight), 0), 0)', 'y_pred', 4)} FROM gap JOIN gw USING (horizon, model) GROUP BY container_id, time_stamp, horizon, y_true"))
def apply_weights(spark, sf_dir):
    """Combined forecasts where one model is missing in every third hour: there the others' weights are rescaled."""
    rows = long(spark, sf_dir)
    some = rows.filter("not (model = 'mean24' and floor(time_stamp / 3600) % 3 = 0)")
    return rounded(fc.apply_weights(some, fc.bates_granger(rows, ["horizon"]).withColumn("left_out", F.lit("none")), ["horizon"]).select("container_id", "time_stamp", "horizon", "y_true", "y_pred"), 6, {"y_pred": 4})


@query("bates_granger", sql(LONG, f", m AS (SELECT horizon, model, 1 / greatest(avg((y_true - y_pred) * (y_true - y_pred)), 1e-12) AS w FROM fc GROUP BY 1, 2) SELECT horizon::BIGINT AS horizon, model, {r('w / sum(w) OVER (PARTITION BY horizon)', 'weight', D)} FROM m"))
def bates_granger(spark, sf_dir):
    return rounded(fc.bates_granger(long(spark, sf_dir), ["horizon"]), D)


@query("best_individual", sql(LONG, f", m AS (SELECT horizon, model, avg(abs(y_true - y_pred)) AS mae FROM fc GROUP BY 1, 2) SELECT horizon::BIGINT AS horizon, first(model ORDER BY mae, model) AS model, {r('min(mae)', 'mae', D)} FROM m GROUP BY 1"))
def best_individual(spark, sf_dir):
    return rounded(fc.best_individual(long(spark, sf_dir), ["horizon"]), D)


_SES = GRID + """, sv AS (SELECT container_id, cpu, row_number() OVER (PARTITION BY container_id ORDER BY time_stamp) AS k, count(*) OVER (PARTITION BY container_id) AS n FROM grid),
ses AS (SELECT container_id, a.alpha, cpu AS level, 0.0::DOUBLE AS sse, k, n FROM sv, (VALUES (0.1::DOUBLE), (0.2::DOUBLE), (0.3::DOUBLE), (0.5::DOUBLE), (0.7::DOUBLE), (0.9::DOUBLE)) AS a(alpha) WHERE k = 1 AND n >= 48
  UNION ALL SELECT s.container_id, s.alpha, s.level + s.alpha * (v.cpu - s.level), s.sse + (v.cpu - s.level) * (v.cpu - s.level), v.k, s.n FROM ses s JOIN sv v ON v.container_id = s.container_id AND v.k = s.k + 1)"""


@query("smoothing_forecast", f"WITH RECURSIVE {_SES} SELECT container_id, {r('first(alpha ORDER BY sse, alpha)', 'alpha')}, {r('min(sse)', 'sse')}, {r('first(level ORDER BY sse, alpha)', 'forecast')} FROM ses WHERE k = n GROUP BY 1")
def smoothing_forecast(spark, sf_dir):
    return rounded(fc.smoothing_forecast(ft.series_arrays(grid(spark, sf_dir))))


@query("adaptive_conformal")
def adaptive_conformal(spark, sf_dir):
    rows = fc.long_forecasts(wide(spark, sf_dir), ("mean24",))
    return rounded(iv.adaptive_conformal(rows))


@query("aggregate_experts")
def aggregate_experts(spark, sf_dir):
    rows = fc.long_forecasts(wide(spark, sf_dir), ("mean24",))
    return rounded(iv.aggregate_experts(iv.adaptive_conformal(rows)))


_GAMMAS = (0.01, 0.02, 0.05, 0.1)
_SHORT = f""", au AS (SELECT horizon, container_id, list(abs(y_true - y_pred) ORDER BY time_stamp) AS e, count(*) AS n FROM fc WHERE model = 'mean24' GROUP BY 1, 2),
ak AS (SELECT horizon, container_id, unnest(range(greatest(1, n // 2), n)) AS k, n, e FROM au),
ao AS (SELECT horizon, container_id, k, e[k + 1] AS e, list_sort(e[greatest(1, k - 199) : k]) AS s FROM ak),
al AS (SELECT horizon, container_id, list({{'e': e, 's': s}} ORDER BY k) AS steps FROM ao GROUP BY 1, 2),
af AS (SELECT horizon, container_id, gamma, list_reduce(steps, lambda acc, x: {{'e': 0.0::DOUBLE, 's': [
    least(0.99, greatest(0.01, acc.s[1] + gamma * (0.2::DOUBLE - (x.e > x.s[1 + floor((len(x.s) - 1) * (1 - acc.s[1]))::BIGINT] + ((len(x.s) - 1) * (1 - acc.s[1]) - floor((len(x.s) - 1) * (1 - acc.s[1]))) * (x.s[least(len(x.s), 2 + floor((len(x.s) - 1) * (1 - acc.s[1]))::BIGINT)] - x.s[1 + floor((len(x.s) - 1) * (1 - acc.s[1]))::BIGINT]))::INT))),
    acc.s[2] + 1,
    acc.s[3] + (x.e > x.s[1 + floor((len(x.s) - 1) * (1 - acc.s[1]))::BIGINT] + ((len(x.s) - 1) * (1 - acc.s[1]) - floor((len(x.s) - 1) * (1 - acc.s[1]))) * (x.s[least(len(x.s), 2 + floor((len(x.s) - 1) * (1 - acc.s[1]))::BIGINT)] - x.s[1 + floor((len(x.s) - 1) * (1 - acc.s[1]))::BIGINT]))::INT,
    acc.s[4] + 2 * (x.s[1 + floor((len(x.s) - 1) * (1 - acc.s[1]))::BIGINT] + ((len(x.s) - 1) * (1 - acc.s[1]) - floor((len(x.s) - 1) * (1 - acc.s[1]))) * (x.s[least(len(x.s), 2 + floor((len(x.s) - 1) * (1 - acc.s[1]))::BIGINT)] - x.s[1 + floor((len(x.s) - 1) * (1 - acc.s[1]))::BIGINT]))]}},
    {{'e': 0.0::DOUBLE, 's': [0.2::DOUBLE, 0.0, 0.0, 0.0]}}).s AS f FROM al, (VALUES {', '.join(f'({g}::DOUBLE)' for g in _GAMMAS)}) AS g(gamma)),
ac2 AS (SELECT horizon, 'mean24' AS model, container_id, gamma, f[2] AS n, 1 - f[3] / f[2] AS coverage, f[4] / f[2] AS width, f[1] AS last_alpha FROM af)"""


@query("adaptive_conformal_short", sql(LONG + _SHORT, f"SELECT horizon::BIGINT AS horizon, model, container_id, {r('gamma', 'gamma')}, n::BIGINT AS n, {r('coverage', 'coverage')}, {r('width', 'width')}, {r('last_alpha', 'last_alpha')} FROM ac2"))
def adaptive_conformal_short(spark, sf_dir):
    """Adaptive intervals with a buffer of 200 residuals, which SQL can fold."""
    return rounded(iv.adaptive_conformal(fc.long_forecasts(wide(spark, sf_dir), ("mean24",)), _GAMMAS, buffer=200))


_EXPERTS = """, ar AS (SELECT *, exp(-10 * (1 - coverage - min(1 - coverage) OVER (PARTITION BY horizon, container_id))) AS raw FROM ac2), aw AS (SELECT *, raw / sum(raw) OVER (PARTITION BY horizon, container_id) AS weight FROM ar)"""


@query("aggregate_experts_short", sql(LONG + _SHORT + _EXPERTS, f"SELECT horizon::BIGINT AS horizon, model, {r('sum(weight * width) / sum(weight)', 'width')}, {r('avg(coverage)', 'mean_coverage')} FROM aw GROUP BY 1, 2"))
def aggregate_experts_short(spark, sf_dir):
    """Step sizes weighted by their misses, over intervals with a buffer of 200 residuals."""
    return rounded(iv.aggregate_experts(iv.adaptive_conformal(fc.long_forecasts(wide(spark, sf_dir), ("mean24",)), _GAMMAS, buffer=200)))


@query("expert_bounds")
def expert_bounds(spark, sf_dir):
    """Bounds of every step by all step sizes together; a fold by series, which tests hold against a plain loop."""
    rows = fc.forecast_columns(grid(spark, sf_dir), HORIZONS, PER_DAY)
    return rounded(iv.expert_bounds_panel(rows, HORIZONS, {"mean24": "mean24"}, CPU, kept=("s_{h}", "mean6")))


@query("leaderboard", sql(LONG, "SELECT horizon::BIGINT AS horizon, " + ", ".join(f"round({r2('y_pred').replace('count(*)', f'''count(*) FILTER (model = '{m}')''').replace('sum((y_true - y_pred) * (y_true - y_pred))', f'''sum((y_true - y_pred) * (y_true - y_pred)) FILTER (model = '{m}')''').replace('var_pop(y_true)', f'''var_pop(y_true) FILTER (model = '{m}')''')}, 4) + 0.0 AS {m}" for m in MODELS) + " FROM fc GROUP BY 1"))
def leaderboard(spark, sf_dir):
    m = ev.forecast_metrics(long(spark, sf_dir), ["horizon", "model"])
    return rounded(m.groupBy("horizon").pivot("model", MODELS).agg(F.first("r2")), 4)


@query("residual_variance_reduction", sql(LONG, f", m AS (SELECT horizon, model, {r2('y_pred')} AS a, {r2('y_naive')} AS b FROM fc GROUP BY 1, 2) SELECT horizon::BIGINT AS horizon, model, {r('CASE WHEN 1 - b > 1e-6 THEN 1 - (1 - a) / nullif(1 - b, 0) END', 'reduction', D)} FROM m"))
def residual_variance_reduction(spark, sf_dir):
    m = long(spark, sf_dir).groupBy("horizon", "model").agg(r2_of(F.col("y_true"), F.col("y_pred")).alias("r2"), r2_of(F.col("y_true"), F.col("y_naive")).alias("r2_naive"))
    return rounded(ev.variance_reduction(m).select("horizon", "model", "reduction"), D)

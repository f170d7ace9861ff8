"""Queries: features, targets, origins, folds, predictability."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import features as ft
from ..operators import predictability as pr
from ..registry import query
from ..sources.panel import CPU
from .fixtures import DISK_GRID, GRID, HORIZONS, PANEL, PER_DAY, disk_grid, grid, panel, r, rounded

H, M = 2, 3  # the horizon of the checked feature frame in steps, and the newest row that its features see
W = "PARTITION BY container_id ORDER BY time_stamp"


def sql(prefix: str, rest: str) -> str:
    return f"WITH {prefix} {rest}"


def lag(c: str, k: int) -> str:
    return f"lag({c}, {k}) OVER ({W})"


_OFFSETS = [k for k in ft.OFFSETS if M + k <= ft.LONGEST]


@query("lag_features", sql(GRID, "SELECT container_id, time_stamp, " + ", ".join(r(lag(a, M + k), f"{a}_lag_{M + k}") for a in ("cpu", "mem") for k in _OFFSETS) + " FROM grid"))
def lag_features(spark, sf_dir):
    g = grid(spark, sf_dir)
    return rounded(g.select("container_id", "time_stamp", *[c.alias(n) for n, c in ft.lag_features(H).items()]))


_AGG = {"mean": "avg({c})", "std": "coalesce(stddev_samp({c}), 0)", "min": "min({c})", "max": "max({c})"}


def _roll(c: str, kind: str, w: int) -> str:
    over = f"OVER ({W} ROWS BETWEEN {M + w - 1} PRECEDING AND {M} PRECEDING)"
    return f"coalesce(stddev_samp({c}) {over}, 0)" if kind == "std" else f"{'avg' if kind == 'mean' else kind}({c}) {over}"


@query("rolling_features", sql(GRID, "SELECT container_id, time_stamp, " + ", ".join(r(_roll(a, k, w), f"{a}_{k}_{w}", 5 if k == "std" else 7) for a in ("cpu", "mem") for w in ft.WINDOWS for k in _AGG) + " FROM grid"))
def rolling_features(spark, sf_dir):
    cols = ft.rolling_names()
    out = ft.with_rolling(grid(spark, sf_dir), H).select("container_id", "time_stamp", *cols)
    return rounded(out, 7, {n: 5 for n in cols if "_std_" in n})


_BASE = ", f AS (SELECT *, " + ", ".join([f"{lag(a, M + k)} AS {a}{k}" for a in ("cpu", "mem") for k in (0, 1, 2, 3, 47)] + [f"{_roll(a, 'mean', w)} AS {a}_mean_{w}" for a in ("cpu", "mem") for w in (6, 12, 24)] + [f"{_roll(a, k, 12)} AS {a}_{k}_12" for a in ("cpu", "mem") for k in ("std", "min", "max")] + [f"{lag(a, PER_DAY + M)} AS {a}_day" for a in ("cpu", "mem")]) + " FROM grid)"


def _frame(spark, sf_dir):
    return ft.feature_frame(grid(spark, sf_dir), H, PER_DAY)


def _pick(frame, names):
    return rounded(frame.select("container_id", "time_stamp", *names))


_TREND = {"trend_short": "{a}0 - {a}1", "trend_medium": "{a}0 - {a}2", "trend_long": "{a}0 - {a}47", "momentum": "{a}_mean_6 - {a}_mean_24"}


@query("trend_momentum", sql(GRID + _BASE, "SELECT container_id, time_stamp, " + ", ".join(r(x.format(a=a), f"{a}_{n}") for a in ("cpu", "mem") for n, x in _TREND.items()) + " FROM f"))
def trend_momentum(spark, sf_dir):
    return _pick(_frame(spark, sf_dir), [f"{a}_{n}" for a in ("cpu", "mem") for n in _TREND])


_DIFF = {"accel": "coalesce({a}0 - 2 * {a}1 + {a}2, 0)", "jerk": "coalesce({a}0 - 3 * {a}1 + 3 * {a}2 - {a}3, 0)"}


@query("accel_jerk", sql(GRID + _BASE, "SELECT container_id, time_stamp, " + ", ".join(r(x.format(a=a), f"{a}_{n}") for a in ("cpu", "mem") for n, x in _DIFF.items()) + " FROM f"))
def accel_jerk(spark, sf_dir):
    return _pick(_frame(spark, sf_dir), [f"{a}_{n}" for a in ("cpu", "mem") for n in _DIFF])


_VOL = {"volatility": "coalesce({a}_std_12, 0)", "cv": "coalesce({a}_std_12 / ({a}_mean_12 + 1e-6), 0)", "range": "coalesce({a}_max_12 - {a}_min_12, 0)"}


@query("volatility_features", sql(GRID + _BASE, "SELECT container_id, time_stamp, " + ", ".join(r(x.format(a=a), f"{a}_{n}", 4) for a in ("cpu", "mem") for n, x in _VOL.items()) + " FROM f"))
def volatility_features(spark, sf_dir):
    return rounded(_frame(spark, sf_dir).select("container_id", "time_stamp", *[f"{a}_{n}" for a in ("cpu", "mem") for n in _VOL]), 4)


@query("cross_resource_features", sql(GRID + _BASE, f"""SELECT container_id, time_stamp, {r('cpu0 / (mem0 + 1e-6)', 'cpu_mem_ratio', 5)}, {r('cpu0 * mem0 / 100', 'cpu_mem_product', 5)}, {r('cpu0 - mem0', 'cpu_mem_diff', 5)},
  coalesce(cpu0 > 70 AND mem0 > 70, false)::BIGINT AS saturation, {r('CASE WHEN (cpu0 - cpu1) * (mem0 - mem1) IS NOT NULL THEN greatest(-100.0, least(100.0, (cpu0 - cpu1) * (mem0 - mem1))) END', 'corr_proxy', 5)},
  coalesce(sign(cpu0 - cpu1) <> sign(mem0 - mem1), true)::BIGINT AS divergence FROM f"""))
def cross_resource_features(spark, sf_dir):
    return rounded(_frame(spark, sf_dir).select("container_id", "time_stamp", "cpu_mem_ratio", "cpu_mem_product", "cpu_mem_diff", "saturation", "corr_proxy", "divergence"), 5)


@query("same_time_yesterday", sql(GRID + _BASE, "SELECT container_id, time_stamp, " + ", ".join(f"{r(f'coalesce({a}_day, {a}0)', f'{a}_same_time_1d')}, {r(f'coalesce({a}0 - {a}_day, 0)', f'{a}_diff_1d')}" for a in ("cpu", "mem")) + " FROM f"))
def same_time_yesterday(spark, sf_dir):
    return _pick(_frame(spark, sf_dir), [f"{a}_{n}" for a in ("cpu", "mem") for n in ("same_time_1d", "diff_1d")])


_T = 2 * math.pi
_HOUR, _DOW = "((time_stamp % 86400) / 3600.0)::DOUBLE", "((time_stamp // 86400) % 7)::BIGINT"


@query("cyclic_calendar", sql(PANEL, f"SELECT event_id, {r(_HOUR, 'hour')}, {_DOW} AS dow, {r(f'sin({_HOUR} * {_T / 24})', 'hour_sin')}, {r(f'cos({_HOUR} * {_T / 24})', 'hour_cos')}, {r(f'sin({_DOW} * {_T / 7})', 'dow_sin')}, {r(f'cos({_DOW} * {_T / 7})', 'dow_cos')}, ({_HOUR} BETWEEN 9 AND 17)::BIGINT AS business FROM panel"))
def cyclic_calendar(spark, sf_dir):
    c = ft.cyclic_calendar()
    return rounded(panel(spark, sf_dir).select("event_id", *[x.alias(n) for n, x in c.items()]))


_VMH = "(hour(make_timestamp(time_stamp * 1000000)) + minute(make_timestamp(time_stamp * 1000000)) / 60.0)::DOUBLE"
_VMD = "(isodow(make_timestamp(time_stamp * 1000000)) - 1)::BIGINT"


@query("vm_calendar", sql(PANEL, f"SELECT event_id, {r(_VMH, 'vm_hour')}, {_VMD} AS vm_dow, ({_VMH} >= 8 AND {_VMH} < 18 AND {_VMD} < 5)::BIGINT AS vm_business FROM panel"))
def vm_calendar(spark, sf_dir):
    return rounded(panel(spark, sf_dir).select("event_id", *[x.alias(n) for n, x in ft.vm_calendar().items()]))


@query("forecast_target", sql(GRID, "SELECT container_id, time_stamp, " + ", ".join(f"{r(f'lead({a}, {H}) OVER ({W})', f'{a}_target')}, {r(a, f'naive_{a}')}, {r(f'lead({a}, {H}) OVER ({W}) - {a}', f'{a}_residual')}" for a in ("cpu", "mem")) + " FROM grid"))
def forecast_target(spark, sf_dir):
    return rounded(grid(spark, sf_dir).select("container_id", "time_stamp", *[c.alias(n) for n, c in ft.forecast_target(H).items()]))


@query("drop_null_targets", sql(GRID, f", t AS (SELECT container_id, time_stamp, cpu, mem, lead(cpu, {H}) OVER ({W}) AS a, lead(mem, {H}) OVER ({W}) AS b FROM grid) SELECT container_id, time_stamp FROM t WHERE a IS NOT NULL AND b IS NOT NULL AND cpu IS NOT NULL AND mem IS NOT NULL"))
def drop_null_targets(spark, sf_dir):
    g = grid(spark, sf_dir)
    return ft.drop_null_targets(g.withColumns(ft.forecast_target(H))).select("container_id", "time_stamp")


_NAMES = ", ".join(f"('{n}')" for n in ft.feature_names(H))
_GROUP = f"""CASE WHEN regexp_extract(name, '_lag_([0-9]+)$', 1) <> '' THEN CASE WHEN regexp_extract(name, '_lag_([0-9]+)$', 1)::INT <= {H + 4} THEN 'lag_immediate' ELSE 'lag_distant' END
 WHEN regexp_matches(name, '_(mean|min|max)_') THEN 'rolling_level' WHEN regexp_matches(name, '_std_') THEN 'rolling_spread' WHEN regexp_matches(name, 'trend|momentum') THEN 'trend' WHEN regexp_matches(name, 'accel|jerk') THEN 'difference'
 WHEN regexp_matches(name, 'volatility|_cv|_range') THEN 'volatility' WHEN regexp_matches(name, '_1d$') THEN 'daily' WHEN regexp_matches(name, '^cpu_mem|saturation|corr_proxy|divergence') THEN 'cross_resource' ELSE 'calendar' END"""


@query("feature_groups", sql(GRID, f", n(name) AS (VALUES {_NAMES}) SELECT name, {_GROUP} AS feature_group, (SELECT count(*) FROM grid)::BIGINT AS n_rows FROM n"))
def feature_groups(spark, sf_dir):
    """The columns that the feature frame of the panel really has, their groups and its rows."""
    frame = _frame(spark, sf_dir)
    names = [c for c in frame.columns if c in set(ft.feature_names(H))]
    counted = frame.groupBy().agg(F.count("*").alias("n_rows"))
    named = counted.withColumn("name", F.explode(F.array(*map(F.lit, names))))
    return named.select("name", ft.feature_group(F.col("name"), H).alias("feature_group"), "n_rows")


def _full(kind: str, w: int) -> str:
    over = f"OVER ({W} ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)"
    x = f"CASE WHEN count(*) {over} = {w} THEN {kind}(cpu) {over} END"
    return f"coalesce({x}, 0)" if kind == "stddev_samp" else x


_VM = [f"{lag('cpu', k)} AS lag_{k}" for k in range(1, 13)] + [f"{_full(k, w)} AS {n}_{w}" for w in (3, 6, 12) for n, k in (("mean", "avg"), ("std", "stddev_samp"), ("max", "max"))] + [f"coalesce({lag('cpu', max(1, PER_DAY - H))}, {lag('cpu', 1)}) AS yesterday", f"lead(cpu, {H}) OVER ({W}) AS target"]
_VM_OUT = [f"lag_{k}" for k in range(1, 13)] + [f"{n}_{w}" for w in (3, 6, 12) for n in ("mean", "std", "max")] + ["yesterday", "target"]


@query("vm_features", sql(GRID, f", v AS (SELECT container_id, time_stamp, {', '.join(_VM)} FROM grid) SELECT container_id, time_stamp, {', '.join(r(c, c, 5) for c in _VM_OUT)}, {', '.join(r(f'lag_1 - lag_{k}', f'trend_{k}', 5) for k in (2, 6, 12))}, {r('mean_3 - mean_12', 'momentum', 5)} FROM v WHERE target IS NOT NULL AND lag_1 IS NOT NULL AND lag_12 IS NOT NULL"))
def vm_features(spark, sf_dir):
    f = ft.vm_features(grid(spark, sf_dir), H, PER_DAY)
    return rounded(f.select("container_id", "time_stamp", *_VM_OUT, "trend_2", "trend_6", "trend_12", "momentum"), 5)


_WINDOWED = {n: lag({"cpu": "cpu", "mem": "mem", "disk": "disk"}[n.split("_")[0]], k) for n, (_, k) in ft.lag_names(H, True).items()}
_WINDOWED |= {f"{a}_{k}_{w}": _roll(a, k, w) for a in ("cpu", "mem") for w in ft.WINDOWS for k in _AGG} | {f"{a}_day": lag(a, PER_DAY + M) for a in ("cpu", "mem")} | {f"{a}_target": f"lead({a}, {H}) OVER ({W})" for a in ("cpu", "mem")}
_NEWEST = {f"{{a}}{k}": f"{{a}}_lag_{M + k}" for k in (0, 1, 2, 3, 47)}


def _of(x: str, a: str) -> str:
    """An expression over the newest values allowed, in the names of the frame."""
    for short, name in sorted(_NEWEST.items(), key=lambda p: -len(p[0])):
        x = x.replace(short, name)
    return x.format(a=a)


_EVERY = {n: n for n in _WINDOWED if not n.endswith("_day")}
_EVERY |= {f"{a}_{n}": _of(x, a) for a in ("cpu", "mem") for n, x in (_TREND | _DIFF | _VOL).items()}
_EVERY |= {f"{a}_{n}": _of(x, a) for a in ("cpu", "mem") for n, x in (("same_time_1d", "coalesce({a}_day, {a}0)"), ("diff_1d", "coalesce({a}0 - {a}_day, 0)"))}
_C, _D = f"cpu_lag_{M}", f"mem_lag_{M}"
_PRODUCT = f"({_C} - cpu_lag_{M + 1}) * ({_D} - mem_lag_{M + 1})"
_EVERY |= {"cpu_mem_ratio": f"{_C} / ({_D} + 1e-6)", "cpu_mem_product": f"{_C} * {_D} / 100", "cpu_mem_diff": f"{_C} - {_D}", "corr_proxy": f"CASE WHEN {_PRODUCT} IS NOT NULL THEN greatest(-100.0, least(100.0, {_PRODUCT})) END"}
_EVERY |= {"hour": _HOUR, "hour_sin": f"sin({_HOUR} * {_T / 24})", "hour_cos": f"cos({_HOUR} * {_T / 24})", "dow_sin": f"sin({_DOW} * {_T / 7})", "dow_cos": f"cos({_DOW} * {_T / 7})"}
_EVERY |= {"naive_cpu": "cpu", "naive_mem": "mem", "cpu_residual": "cpu_target - cpu", "mem_residual": "mem_target - mem"}
_WHOLE = {"saturation": f"coalesce({_C} > 70 AND {_D} > 70, false)::BIGINT", "divergence": f"coalesce(sign({_C} - cpu_lag_{M + 1}) <> sign({_D} - mem_lag_{M + 1}), true)::BIGINT", "dow": _DOW, "business": f"({_HOUR} BETWEEN 9 AND 17)::BIGINT"}
#: Digits of the results: fewer where a deviation is part of a value.
_DIGITS = {n: 7 for n in _EVERY if "_mean_" in n} | {n: 4 if n.partition("_")[2] in ("volatility", "cv", "range") else 5 for n in _EVERY if "_std_" in n or n.partition("_")[2] in ("volatility", "cv", "range") or n.startswith("cpu_mem_") or n == "corr_proxy"}
_ALL = sql(DISK_GRID, f", f AS (SELECT container_id, time_stamp, cpu, mem, {', '.join(f'{x} AS {n}' for n, x in _WINDOWED.items())} FROM grid) SELECT container_id, time_stamp, {', '.join(r(x, n, _DIGITS.get(n, 6)) for n, x in _EVERY.items())}, {', '.join(f'{x} AS {n}' for n, x in _WHOLE.items())} FROM f")


def _every(frame):
    return rounded(frame.select("container_id", "time_stamp", *_EVERY, *_WHOLE), 6, _DIGITS)


@query("feature_frame", _ALL)
def feature_frame(spark, sf_dir):
    """The whole feature build: every feature and target of every row, lags of disk use among them."""
    return _every(ft.feature_frame(disk_grid(spark, sf_dir), H, PER_DAY))


@query("latest_feature_row", _ALL + " WHERE cpu IS NOT NULL QUALIFY row_number() OVER (PARTITION BY container_id ORDER BY time_stamp DESC) = 1")
def latest_feature_row(spark, sf_dir):
    """All features of the newest row of each series, for scoring now."""
    return _every(ft.latest_feature_row(ft.feature_frame(ft.mark_newest(disk_grid(spark, sf_dir)), H, PER_DAY)))


_N = ", n AS (SELECT container_id, count(*) AS n FROM grid GROUP BY 1), h(horizon) AS (VALUES " + ", ".join(f"({h})" for h in HORIZONS) + ")"


def _origins(first: int, k: int) -> str:
    at = f"round_even((lo + i * (hi - lo) / {k - 1}.0)::DECIMAL(18, 6), 0)::BIGINT"
    return sql(GRID + _N, f", b AS (SELECT container_id, horizon::BIGINT AS horizon, {first} AS lo, n - horizon - 1 AS hi FROM n, h WHERE n - horizon - 1 >= {first}) SELECT DISTINCT container_id, horizon, {at} AS origin FROM b, range({k}) AS s(i)")


@query("rolling_origins", _origins(23, 20))
def rolling_origins(spark, sf_dir):
    return rounded(ft.rolling_origins(grid(spark, sf_dir), HORIZONS))


@query("rolling_origins_b", _origins(24, 20))
def rolling_origins_b(spark, sf_dir):
    return rounded(ft.rolling_origins(grid(spark, sf_dir), HORIZONS, rule="b"))


_OVER128 = f"OVER ({W} ROWS BETWEEN 127 PRECEDING AND CURRENT ROW)"


@query("strided_origins", sql(GRID, f", s AS (SELECT container_id, row_number() OVER ({W}) - 1 AS pos, lead(cpu, {H}) OVER ({W}) AS target, count(cpu) {_OVER128} AS n_context, avg(cpu) {_OVER128} AS context_mean FROM grid) SELECT container_id, pos, {r('target', 'target')}, n_context, {r('context_mean * n_context', 'context_sum', 4)} FROM s WHERE pos >= 1 AND (pos - 1) % 3 = 0 AND target IS NOT NULL AND n_context >= 3"))
def strided_origins(spark, sf_dir):
    s = ft.strided_origins(grid(spark, sf_dir), H).select("container_id", F.col("pos").cast("long").alias("pos"), "target", "n_context", (F.col("context_mean") * F.col("n_context")).alias("context_sum"))
    return rounded(s, other={"context_sum": 4})


@query("lookback_windows", sql(GRID, f", s AS (SELECT container_id, time_stamp, row_number() OVER ({W}) - 1 AS pos, list(cpu) OVER ({W} ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS v FROM grid) SELECT container_id, time_stamp, array_to_string(list_transform(v, lambda x: (round(x * 1000)::BIGINT)::VARCHAR), ' ') AS thousandths FROM s WHERE len(v) = 12 AND pos % 2 = 0"))
def lookback_windows(spark, sf_dir):
    w = ft.lookback_windows(grid(spark, sf_dir), 12, 2)
    return w.select("container_id", "time_stamp", F.array_join(F.transform("values", lambda x: F.round(x * 1000).cast("long").cast("string")), " ").alias("thousandths"))


@query("time_series_cv", sql(GRID, ", b AS (SELECT min(time_stamp) AS t0, max(time_stamp) AS t1 FROM grid), s AS (SELECT least((time_stamp - t0) * 6 // greatest(t1 - t0, 1), 5) AS fold FROM grid, b) SELECT fold::BIGINT AS fold, count(*)::BIGINT AS n FROM s GROUP BY 1"))
def time_series_cv(spark, sf_dir):
    return rounded(ft.time_folds(grid(spark, sf_dir)).groupBy("fold").agg(F.count("*").alias("n")))


@query("series_arrays", sql(GRID, f"SELECT container_id, count(*)::BIGINT AS n, {r('first(cpu ORDER BY time_stamp)', 'first_value')}, {r('last(cpu ORDER BY time_stamp)', 'last_value')} FROM grid GROUP BY 1"))
def series_arrays(spark, sf_dir):
    a = ft.series_arrays(grid(spark, sf_dir))
    return rounded(a.select("container_id", F.size("values").alias("n"), F.element_at("values", 1).alias("first_value"), F.element_at("values", -1).alias("last_value")))


@query("container_index", sql(GRID, ", n AS (SELECT container_id, count(*)::BIGINT AS n_points FROM grid GROUP BY 1) SELECT container_id, n_points, (sum(n_points) OVER (ORDER BY container_id))::BIGINT AS end_idx, (sum(n_points) OVER (ORDER BY container_id) - n_points)::BIGINT AS start_idx FROM n"))
def container_index(spark, sf_dir):
    return ft.container_index(grid(spark, sf_dir))


_MASE = f", c AS (SELECT container_id, cpu, abs(cpu - {lag('cpu', PER_DAY)}) AS change FROM grid), m AS (SELECT container_id, count(*) AS n, count(cpu) AS known, avg(change) AS d FROM c GROUP BY 1), den AS (SELECT container_id, d, CASE WHEN known < n THEN 'null' WHEN n <= {PER_DAY} THEN 'short' WHEN d < 1e-10 THEN 'constant' ELSE 'ok' END AS reason FROM m)"


@query("mase_denominator", sql(GRID + _MASE, "SELECT container_id, " + r("CASE WHEN reason = 'ok' THEN d END", "denominator", 9) + ", reason FROM den"))
def mase_denominator(spark, sf_dir):
    return rounded(ft.mase_denominator(grid(spark, sf_dir), PER_DAY), 9)


def _acf(k: int) -> str:
    return f"covar_samp(x{k}, cpu) / nullif(stddev_samp(CASE WHEN cpu IS NOT NULL THEN x{k} END) * stddev_samp(CASE WHEN x{k} IS NOT NULL THEN cpu END), 0)"


_ACF = f", a AS (SELECT container_id, cpu, {lag('cpu', 1)} AS x1, {lag('cpu', 24)} AS x24 FROM grid)"


@query("acf_pearson", sql(GRID + _ACF, f"SELECT container_id, {r(_acf(1), 'acf_1', 9)}, {r(_acf(24), 'acf_24', 9)} FROM a GROUP BY 1"))
def acf_pearson(spark, sf_dir):
    return rounded(ft.acf(grid(spark, sf_dir), (1, 24)), 9)


@query("series_cv", sql(GRID, f"SELECT container_id, {r('CASE WHEN count(cpu) >= 2 AND avg(cpu) >= 1e-6 THEN stddev_samp(cpu) / nullif(avg(cpu), 0) END', 'cv', 9)} FROM grid GROUP BY 1"))
def series_cv(spark, sf_dir):
    return rounded(pr.series_cv(grid(spark, sf_dir), CPU), 9)


_LAGS = (1, 2, 6, 12, 24)
_ACFG = f", c AS (SELECT container_id, time_stamp, cpu, cpu - avg(cpu) OVER (PARTITION BY container_id) AS c FROM grid), g AS (SELECT container_id, cpu, c, {', '.join(f'c * {lag('c', k)} AS g{k}' for k in _LAGS)} FROM c), acfg AS (SELECT container_id, {', '.join(f'sum(g{k}) / nullif(sum(c * c), 0) AS acfg_{k}' for k in _LAGS)} FROM g GROUP BY 1 HAVING count(cpu) > {max(_LAGS) + 6})"


@query("acf_global_mean", sql(GRID + _ACFG, f"SELECT container_id, {', '.join(r(f'acfg_{k}', f'acfg_{k}', 9) for k in _LAGS)} FROM acfg"))
def acf_global_mean(spark, sf_dir):
    return rounded(pr.acf_global_mean(grid(spark, sf_dir), CPU, _LAGS), 9)


_HURST = f""", hp AS (SELECT container_id, cpu, row_number() OVER ({W}) - 1 AS pos, count(*) OVER (PARTITION BY container_id) AS n FROM grid WHERE cpu IS NOT NULL),
hs AS (SELECT *, pos // size AS chunk FROM hp, (VALUES (8), (16), (32), (64), (128)) AS s(size) WHERE n >= 100 AND (pos // size + 1) * size <= n),
hd AS (SELECT *, cpu - avg(cpu) OVER (PARTITION BY container_id, size, chunk) AS d FROM hs),
hz AS (SELECT *, sum(d) OVER (PARTITION BY container_id, size, chunk ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS z FROM hd),
hc AS (SELECT container_id, size, chunk, max(z) - min(z) AS rr, stddev_pop(cpu) AS s FROM hz GROUP BY ALL HAVING stddev_pop(cpu) > 1e-9),
hm AS (SELECT container_id, size, avg(rr / s) AS rs FROM hc GROUP BY ALL HAVING avg(rr / s) > 0),
hurst AS (SELECT container_id, regr_slope(ln(rs), ln(size)) AS hurst FROM hm GROUP BY 1 HAVING count(*) >= 3)"""


@query("hurst_rs", sql(GRID + _HURST, f"SELECT container_id, {r('hurst', 'hurst', 8)} FROM hurst"))
def hurst_rs(spark, sf_dir):
    return rounded(pr.hurst_rs(grid(spark, sf_dir), CPU), 8)


@query("predictability_table", sql(GRID + _HURST + _ACFG, f"SELECT {r('(SELECT median(CASE WHEN m >= 1e-6 THEN s / m END) FROM (SELECT avg(cpu) AS m, stddev_samp(cpu) AS s FROM grid GROUP BY container_id))', 'median_cv', 8)}, {r('(SELECT median(hurst) FROM hurst)', 'median_hurst', 8)}, {', '.join(r(f'(SELECT median(acfg_{k}) FROM acfg)', f'median_acf_{k}', 8) for k in _LAGS)}"))
def predictability_table(spark, sf_dir):
    return rounded(pr.predictability_table(grid(spark, sf_dir), CPU, _LAGS), 8)


_PERIODS = (2, 3, 4, 6, 8, 12, 24, 48)
_OMEGA = f""", oc AS (SELECT container_id, row_number() OVER ({W}) - 1 AS pos, cpu - avg(cpu) OVER (PARTITION BY container_id) AS c FROM grid),
op AS (SELECT container_id, period, sum(c * cos(2 * 3.141592653589793 * pos / period)) AS a, sum(c * sin(2 * 3.141592653589793 * pos / period)) AS b FROM oc, (VALUES {', '.join(f'({p})' for p in _PERIODS)}) AS s(period) GROUP BY ALL),
os AS (SELECT container_id, (a * a + b * b) / nullif(sum(a * a + b * b) OVER (PARTITION BY container_id), 0) AS p FROM op)"""


@query("forecastability_omega", sql(GRID + _OMEGA, f"SELECT container_id, {r('1 + sum(p * ln(p)) / ln(8)', 'omega', 7)} FROM os WHERE p > 0 GROUP BY 1"))
def forecastability_omega(spark, sf_dir):
    return rounded(pr.spectral_omega(grid(spark, sf_dir), CPU), 7)


_MI = f""", ml AS (SELECT container_id, time_stamp, cpu, lead(cpu, {H}) OVER ({W}) AS later FROM grid),
mb AS (SELECT container_id, ntile(8) OVER (PARTITION BY container_id ORDER BY cpu, time_stamp) AS a, ntile(8) OVER (PARTITION BY container_id ORDER BY later, time_stamp) AS b FROM ml WHERE cpu IS NOT NULL AND later IS NOT NULL),
mc AS (SELECT container_id, a, b, count(*) AS n FROM mb GROUP BY ALL),
mt AS (SELECT *, sum(n) OVER (PARTITION BY container_id) AS t, sum(n) OVER (PARTITION BY container_id, a) AS na, sum(n) OVER (PARTITION BY container_id, b) AS nb FROM mc)"""


@query("mutual_information", sql(GRID + _MI, f"SELECT container_id, {r('sum(n / t * ln(n * t / (na * nb)))', 'mi', 9)} FROM mt GROUP BY 1"))
def mutual_information(spark, sf_dir):
    return rounded(pr.mutual_information(grid(spark, sf_dir), CPU, H), 9)

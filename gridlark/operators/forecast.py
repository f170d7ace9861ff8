"""Forecasters and combiners. A forecast table is long: one row for each series, origin, horizon and model."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import mae, r2, ratio, round_to
from ..sources.panel import CPU
from .prepare import by_time

MODELS = ("persistence", "seasonal", "mean6", "mean24")
KEYS = ["container_id", "time_stamp", "horizon"]


def forecast_columns(panel: DataFrame, horizons: tuple[int, ...], per_day: int) -> DataFrame:
    """``panel`` with target ``y_h`` and seasonal forecast ``s_h`` of each horizon, and the rolling means: a row for each point, in the order of its series."""
    cols = {f"y_{h}": F.lead(CPU, h).over(by_time()) for h in horizons} | {f"s_{h}": F.lag(CPU, max(per_day - h, 0)).over(by_time()) for h in horizons}
    # rounded, so that the mean of equal values equals them and signs of changes mean something
    means = {f"mean{n}": F.avg(CPU).over(by_time().rowsBetween(1 - n, 0)) for n in (6, 24)}
    return panel.withColumns(cols | means).withColumns({m: round_to(F.col(m), 9) for m in means})


def wide_forecasts(panel: DataFrame, horizons: tuple[int, ...], per_day: int, placed: bool = False, kept: tuple[str, ...] = ()) -> DataFrame:
    """``container_id, time_stamp, horizon, y_true, y_naive`` and a column for each model; rows with a target and all models.

    Models: the value now, the value a day before the target, means of the last 6 and 24 values. ``placed``: also
    ``place`` (from 1) of a row among those of its series and horizon, and their number ``n``, from the same sort.
    ``kept``: columns of the panel that stay; rows without a value there go too.
    """
    rows = forecast_columns(panel, horizons, per_day)
    more = []
    if placed:
        known = lambda *names: reduce(Column.__and__, [F.col(c).isNotNull() & ~F.isnan(c) for c in names]).cast("int")
        whole_rows = {h: known(CPU, f"y_{h}", f"s_{h}", "mean6", "mean24") for h in horizons}
        sofar, whole = by_time().rowsBetween(Window.unboundedPreceding, 0), by_time().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        rows = rows.withColumns({f"place_{h}": F.sum(k).over(sofar) for h, k in whole_rows.items()} | {f"n_{h}": F.sum(k).over(whole) for h, k in whole_rows.items()})
        more = ["place", "n"]
    each = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"y_{h}").alias("y_true"), F.col(f"s_{h}").alias("seasonal"), *[F.col(f"{c}_{h}").alias(c) for c in more]) for h in horizons])
    rows = rows.withColumn("h", F.explode(each)).select("container_id", "time_stamp", "h.horizon", "h.y_true", F.col(CPU).alias("y_naive"), F.col(CPU).alias("persistence"), "h.seasonal", "mean6", "mean24", *[f"h.{c}" for c in more], *kept)
    return rows.dropna()


def long_forecasts(wide: DataFrame, models: tuple[str, ...] = MODELS, more: tuple[str, ...] = ()) -> DataFrame:
    """A row for each model, with ``more`` columns of the wide row. Rows stay where they are: unlike ``unpivot``, ``explode`` keeps the partitioning by series, so that windows and sums by series need no further shuffle."""
    each = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("y_pred")) for m in models])
    return wide.select(*KEYS, "y_true", "y_naive", *more, F.explode(each).alias("f")).select(*KEYS, "y_true", "y_naive", "f.model", "f.y_pred", *more)


def gram(wide: DataFrame, models: tuple[str, ...], by: list[str]) -> DataFrame:
    """Sums of products of the models' and the target's residuals over the naive forecast: all that least squares need, in one pass."""
    x = {m: F.col(m) - F.col("y_naive") for m in models}
    y = F.col("y_true") - F.col("y_naive")
    sums = [F.sum(x[a] * x[b]).alias(f"{a}*{b}") for i, a in enumerate(models) for b in models[i:]] + [F.sum(x[a] * y).alias(f"{a}*y") for a in models]
    return wide.groupBy(*by).agg(*sums, F.sum(y * y).alias("y*y"), F.count("*").alias("n"))


def nnls(xx: np.ndarray, xy: np.ndarray) -> np.ndarray:
    """Non-negative least squares from a Gram matrix by trying every support; few models, so few supports."""
    k, best, best_w = len(xy), 0.0, np.zeros(len(xy))
    for size in range(1, k + 1):
        for s in combinations(range(k), size):
            a, b = xx[np.ix_(s, s)], xy[list(s)]
            if abs(np.linalg.det(a)) <= 1e-12 * max(1.0, np.abs(a).max() ** size):
                continue
            w = np.linalg.solve(a, b)
            loss = -float(b @ w)  # the residual sum of squares less that of the target
            if (w >= 0).all() and loss < best - 1e-12:
                best, best_w = loss, np.zeros(k)
                best_w[list(s)] = w
    return best_w


def nnls_weights(wide: DataFrame, models: tuple[str, ...], by: list[str], leave_out: bool = False) -> DataFrame:
    """``by, left_out, model, weight`` with weights that add up to 1 (equal ones where none is positive).

    The sums are few rows, one for each group, and are solved on the driver; ``leave_out`` also solves without each model.
    """
    out = []
    for r in gram(wide, models, by).collect():
        for gone in (None, *models) if leave_out else (None,):
            used = [m for m in models if m != gone]
            w = nnls(*gram_matrix(r, used))
            w = w / w.sum() if w.sum() > 1e-8 else np.full(len(used), 1 / len(used))
            out += [(*[r[c] for c in by], gone or "none", m, float(x)) for m, x in zip(used, w, strict=True)]
    types = dict(wide.dtypes)
    return wide.sparkSession.createDataFrame(out, ", ".join(f"{c} {types[c]}" for c in by) + ", left_out string, model string, weight double")


def ridge_cv(wide: DataFrame, models: tuple[str, ...], by: list[str], sums: list, alphas: tuple[float, ...] = (0.01, 0.1, 1.0, 10.0)) -> dict[tuple, tuple[float, np.ndarray]]:
    """Penalty and weights of a ridge regression without intercept for each group, the penalty by least leave-one-out error (the first of equal ones).

    ``sums``: the rows of :func:`gram`. The eigenvectors of a group's sums give its weights and the matrix of its
    leverages for every penalty; one pass over the rows then takes all left-out errors, ``(y - wx) / (1 - h)``. Their
    squares are added up less those of the first penalty: over many rows the mean squares agree to more digits than a sum
    of them keeps, the differences do not.
    """
    k, fits = len(models), {}
    for r in sums:
        xx, xy = gram_matrix(r, models)
        values, vectors = np.linalg.eigh(xx)
        fits[tuple(r[c] for c in by)] = [(a, (inverse := (vectors / (values + a)) @ vectors.T) @ xy, inverse) for a in alphas]
    types = dict(wide.dtypes)
    rows = [(*key, [[*map(float, w), *map(float, inverse.ravel())] for _, w, inverse in fit]) for key, fit in fits.items()]
    table = wide.sparkSession.createDataFrame(rows, ", ".join(f"{c} {types[c]}" for c in by) + ", fits array<array<double>>")
    x = [F.col(m) - F.col("y_naive") for m in models]
    errors, left_out = [], []
    for j in range(len(alphas)):
        fit = F.col("fits")[j]
        e = F.col("y_true") - F.col("y_naive") - sum((fit[a] * x[a] for a in range(1, k)), fit[0] * x[0])
        h = sum((fit[k + a * k + b] * x[a] * x[b] for a in range(k) for b in range(k)), F.lit(0.0))
        left_out.append(ratio(e, 1 - h))
        errors.append(F.avg((left_out[j] - left_out[0]) * (left_out[j] + left_out[0])).alias(f"e{j}"))
    got = wide.join(F.broadcast(table), by).groupBy(*by).agg(*errors).collect()  # a row for each group
    best = {}
    for r in got:
        key = tuple(r[c] for c in by)
        j = min(range(len(alphas)), key=lambda j: (r[f"e{j}"] is None, r[f"e{j}"] or 0.0, j))  # noqa: B023
        best[key] = fits[key][j][:2]
    return best


def gram_matrix(r, models: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Products of the models with each other and with the target, from a row of :func:`gram`."""
    at = lambda a, b: r[f"{a}*{b}"] if f"{a}*{b}" in r.__fields__ else r[f"{b}*{a}"]
    return np.array([[at(a, b) for b in models] for a in models], float), np.array([r[f"{a}*y"] for a in models], float)


METHODS = ("nnls", "simple_average", "ridge", "bates_granger", "best_individual")


def weights_text(names: Column, weights: Column) -> Column:
    """Names and weights to three digits in one string: ``a=0.250 b=0.750``."""
    return F.array_join(F.transform(F.arrays_zip(names.alias("name"), weights.alias("weight")), lambda w: F.format_string("%s=%.3f", w["name"], F.round(w["weight"], 3) + 0.0)), " ")


def combine_methods(train: DataFrame, test: DataFrame, models: tuple[str, ...], by: list[str], alphas: tuple[float, ...] = (0.01, 0.1, 1.0, 10.0)) -> DataFrame:
    """``by, method, n_models, alpha, weights, r2, mae``: five ways to combine forecasts in residual space, fitted on ``train`` and scored on ``test``.

    ``nnls``: non-negative least squares, adding up to 1; ``simple_average``; ``ridge``: penalty by leave-one-out
    error, no intercept, used as fitted and shown adding up to 1; ``bates_granger``: by inverse squared error;
    ``best_individual``: the model of least absolute error. Three passes over all: sums of products, left-out errors,
    scores. Groups without training rows have no row, those without test rows NULL scores.
    """
    k, spark = len(models), train.sparkSession
    absolute = train.groupBy(*by).agg(*[F.sum(F.abs(F.col("y_true") - F.col(m))).alias(f"abs*{m}") for m in models])
    sums = gram(train, models, by).join(absolute, by).collect()  # a row for each group
    ridge, rows = ridge_cv(train, models, by, sums, alphas), []
    for r in sums:
        key, (xx, xy) = tuple(r[c] for c in by), gram_matrix(r, models)
        w = nnls(xx, xy)
        mse = (np.diag(xx) - 2 * xy + r["y*y"]) / r["n"]
        inverse = 1 / np.maximum(mse, 1e-12)
        best = np.eye(k)[min(range(k), key=lambda a: (r[f"abs*{models[a]}"], a))]  # noqa: B023
        alpha, ridge_w = ridge[key]
        for method, w in zip(METHODS, (w / w.sum() if w.sum() > 1e-8 else np.full(k, 1 / k), np.full(k, 1 / k), ridge_w, inverse / inverse.sum(), best), strict=True):
            shown = w / w.sum() if method == "ridge" and abs(w.sum()) > 1e-8 else w
            rows.append((*key, method, 1 if method == "best_individual" else k, alpha if method == "ridge" else None, [*map(float, w)], [*map(float, shown)]))
    types = dict(train.dtypes)
    table = spark.createDataFrame(rows, ", ".join(f"{c} {types[c]}" for c in by) + ", method string, n_models long, alpha double, w array<double>, shown array<double>")
    p = F.col("y_naive") + sum((F.col("w")[a] * (F.col(m) - F.col("y_naive")) for a, m in enumerate(models)), F.lit(0.0))
    scored = test.join(F.broadcast(table.select(*by, "method", "w")), by).groupBy(*by, "method").agg(r2(F.col("y_true"), p).alias("r2"), mae(F.col("y_true"), p).alias("mae"))
    text = weights_text(F.array(*map(F.lit, models)), F.col("shown"))
    return table.select(*by, "method", "n_models", "alpha", text.alias("weights")).join(scored, [*by, "method"], "left")


def apply_weights(long: DataFrame, weights: DataFrame, by: list[str]) -> DataFrame:
    """Combined forecasts: naive plus the weighted residuals of the models that a row has, by weights rescaled to those."""
    got = long.join(F.broadcast(weights), [*by, "model"])  # one row for each group and model
    keys = [*KEYS, "left_out", "y_true", "y_naive"]
    s = got.groupBy(*keys).agg(F.sum(F.col("weight") * (F.col("y_pred") - F.col("y_naive"))).alias("s"), F.sum("weight").alias("w"))
    return s.select(*keys, (F.col("y_naive") + F.coalesce(ratio(F.col("s"), F.col("w")), F.lit(0.0))).alias("y_pred"))


def combined(wide: DataFrame, weights: DataFrame, models: tuple[str, ...], by: list[str]) -> DataFrame:
    """As :func:`apply_weights`, from wide rows: a model's forecasts lie beside each other, so that nothing is grouped or shuffled.

    A row comes once for each ``left_out`` of its group; models that are NULL in a row or have no weight count as missing.
    """
    table = weights.groupBy(*by, "left_out").agg(*[F.max(F.when(F.col("model") == m, F.col("weight"))).alias(f"w*{m}") for m in models])
    there = {m: F.when(F.col(m).isNotNull(), F.coalesce(f"w*{m}", F.lit(0.0))).otherwise(0.0) for m in models}
    s = sum((F.coalesce(w * (F.col(m) - F.col("y_naive")), F.lit(0.0)) for m, w in there.items()), F.lit(0.0))
    got = wide.join(F.broadcast(table), by).withColumns({"s*": s, "w*": sum(there.values(), F.lit(0.0))})  # a row for each group and model left out
    return got.select(*KEYS, "left_out", "y_true", "y_naive", (F.col("y_naive") + F.coalesce(ratio(F.col("s*"), F.col("w*")), F.lit(0.0))).alias("y_pred"))


def bates_granger(long: DataFrame, by: list[str]) -> DataFrame:
    """Weights by inverse mean squared error."""
    mse = long.groupBy(*by, "model").agg(F.avg((F.col("y_true") - F.col("y_pred")) * (F.col("y_true") - F.col("y_pred"))).alias("mse"))
    inverse = 1 / F.greatest(F.col("mse"), F.lit(1e-12))
    return mse.withColumn("weight", inverse / F.sum(inverse).over(Window.partitionBy(*by))).drop("mse")


def best_individual(long: DataFrame, by: list[str]) -> DataFrame:
    """The model of least mean absolute error, the first by name among equals."""
    err = long.groupBy(*by, "model").agg(F.avg(F.abs(F.col("y_true") - F.col("y_pred"))).alias("mae"))
    return err.groupBy(*by).agg(F.min(F.struct("mae", "model")).alias("b")).select(*by, "b.model", "b.mae")


def smoothed(values: Column, alpha: Column) -> Column:
    """Sum of squared one-step errors and last level of simple exponential smoothing over an array."""
    start = F.struct(F.element_at(values, 1).alias("level"), F.lit(0.0).alias("sse"))

    def step(acc: Column, x: Column) -> Column:
        e = x - acc["level"]
        return F.struct((acc["level"] + alpha * e).alias("level"), (acc["sse"] + e * e).alias("sse"))

    return F.aggregate(F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0))), start, step)


def smoothing_forecast(arrays: DataFrame, alphas: tuple[float, ...] = (0.1, 0.2, 0.3, 0.5, 0.7, 0.9), min_n: int = 48) -> DataFrame:
    """Simple exponential smoothing of every series: the alpha of least error, and the forecast it gives."""
    rows = arrays.filter(F.size("values") >= min_n).withColumn("alpha", F.explode(F.array(*map(F.lit, alphas))))
    rows = rows.withColumn("s", smoothed(F.col("values"), F.col("alpha")))
    best = rows.groupBy("container_id").agg(F.min(F.struct(F.col("s.sse").alias("sse"), F.col("alpha"), F.col("s.level").alias("level"))).alias("b"))
    return best.select("container_id", "b.alpha", "b.sse", F.col("b.level").alias("forecast"))

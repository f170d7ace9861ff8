"""Leaderboards and tables of results: pivots, merges, winners, audits, importances, permutation tests."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import average_rank, normal_cdf, normal_inverse, poisson_one, ratio
from ..scratch import materialise
from ..sources.panel import hash_part


def pivot_metric(metrics: DataFrame, by: list[str], column: str, values: list[str], metric: str) -> DataFrame:
    """One row for each ``by``, one column for each of ``values``; the metric's only value, NULL where there is none."""
    return metrics.groupBy(*by).pivot(column, values).agg(F.first(metric, ignorenulls=True))


def leaderboard_merge(board: DataFrame, results: DataFrame, keys: list[str], model: str) -> DataFrame:
    """``board`` with the results (``r2, n_points``) of a further model, their gap to the naive reference in points, and whether both counted the same points.

    Keys without results keep NULLs; results without a row of the board are left out.
    """
    got = results.select(*keys, F.col("r2").alias(f"{model}_r2"), F.col("n_points").alias(f"{model}_n_points"))
    merged = board.join(got, keys, "left")
    return merged.withColumn(f"{model}_delta_pp", 100 * (F.col(f"{model}_r2") - F.col("naive_r2"))).withColumn("same_points", F.col("n_points") == F.col(f"{model}_n_points"))


def best_model(board: DataFrame, models: list[str]) -> DataFrame:
    """``best`` and ``best_r2``: the column of largest value in each row, the first named among equals; NULLs are ignored."""
    values = F.greatest(*map(F.col, models)) if len(models) > 1 else F.col(models[0])
    best = F.coalesce(*[F.when(F.col(m) == values, m) for m in models])
    return board.withColumn("best", best).withColumn("best_r2", values)


def fixed_order(column: str, order: list) -> F.Column:
    """Place of a value in a fixed order, 999 where it has none."""
    return F.coalesce(*[F.when(F.col(column) == v, i) for i, v in enumerate(order)], F.lit(999))


def published_value_audit(expected: DataFrame, actual: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """Published values against recomputed ones: PASS within the tolerance, FAIL beyond it, OVERFLOW above 1e10, MISSING without a recomputed one."""
    both = expected.join(actual, keys, "left")
    gap = F.abs(F.col("expected") - F.col("actual"))
    status = F.when(F.col("actual").isNull(), "MISSING").when(F.abs("actual") > 1e10, "OVERFLOW").when(gap < tolerance, "PASS").otherwise("FAIL")
    return both.withColumn("gap", gap).withColumn("status", status)


def simple_average(wide: DataFrame, models: list[str]) -> F.Column:
    """Mean of the models' forecasts."""
    return sum((F.col(m) for m in models[1:]), F.col(models[0])) / len(models)


def importance_shares(importance: DataFrame, by: list[str], group: str) -> DataFrame:
    """Importance of each group of features as a percentage of all and relative to the largest group."""
    per = importance.groupBy(*by, group).agg(F.sum("importance").alias("importance"), F.count("*").alias("n_features"))
    w = Window.partitionBy(*by)
    return per.withColumn("share_pct", 100 * ratio(F.col("importance"), F.sum("importance").over(w))).withColumn("relative", ratio(F.col("importance"), F.max("importance").over(w)))


def top_features(importance: DataFrame, n: int) -> DataFrame:
    """The ``n`` features of largest mean importance, the first by name among equals: a top-n report."""
    return importance.groupBy("feature").agg(F.avg("importance").alias("importance")).orderBy(F.desc("importance"), "feature").limit(n)


def permutation_p(cells: DataFrame, by: list[str], score: str, label: str, key: str, replicates: int = 200) -> DataFrame:
    """``auc, p, p_plain`` of a score by shuffled labels: ``(shuffles that reach it + 1) / (replicates + 1)``, and the plain share.

    A shuffle deals the labels, in order of ``key``, to the rows in order of a hash of key and replicate. Cells are
    series, not points; ranks are computed once, and a replicate sums ranks.
    """
    ranked = cells.withColumn("rank", average_rank(by, F.col(score)))
    n, pos = F.count("*").alias("n"), F.sum(label).alias("pos")
    own = ranked.groupBy(*by).agg(n, pos, F.sum(F.when(F.col(label) == 1, F.col("rank")).otherwise(0.0)).alias("s"))
    dealt = ranked.select(*by, F.col(label).alias("y"), F.row_number().over(Window.partitionBy(*by).orderBy(key)).alias("place"))
    drawn = ranked.select(*by, key, "rank", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"))
    order = Window.partitionBy(*by, "replicate").orderBy(hash_part(F.concat_ws("/", key, "replicate")), key)
    drawn = drawn.withColumn("place", F.row_number().over(order)).join(dealt, [*by, "place"])
    sums = drawn.groupBy(*by, "replicate").agg(F.sum(F.when(F.col("y") == 1, F.col("rank")).otherwise(0.0)).alias("drawn"))
    reached = sums.join(own, by).groupBy(*by).agg(F.sum((F.col("drawn") >= F.col("s")).cast("long")).alias("reached"))
    got = own.join(reached, by)
    pairs = (F.col("pos") * (F.col("n") - F.col("pos"))).cast("double")
    auc = ratio(F.col("s") - F.col("pos") * (F.col("pos") + 1) / 2, pairs)
    return got.select(*by, "n", "pos", auc.alias("auc"), ((F.col("reached") + 1) / (replicates + 1.0)).alias("p"), (F.col("reached") / float(replicates)).alias("p_plain"))


def auc_bca(cells: DataFrame, by: list[str], score: str, label: str, key: str, replicates: int = 1000, alpha: float = 0.05) -> DataFrame:
    """``auc, z0, acceleration, lo, hi``: bias-corrected and accelerated bootstrap interval of a score's AUC.

    A replicate weighs each cell by a Poisson(1) number from an md5 hash of key and replicate; cells of one score are
    added up before the ranks are formed. The acceleration comes from leaving out one cell at a time, which needs no
    refit: a positive cell takes its negatives below with it, a negative one its positives above. Cells without a
    score or label are left out; with one class only all figures are NULL. Replicates with one class are left out.
    """
    yes, no = F.col(label), 1 - F.col(label)
    cells = cells.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
    upto = Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, 0)
    each = Window.partitionBy(*by)
    levels = cells.groupBy(*by, score).agg(F.sum(yes).alias("p"), F.sum(no).alias("q"))
    levels = levels.withColumns({"below": F.sum("q").over(upto) - F.col("q") / 2, "above": F.sum("p").over(each) - F.sum("p").over(upto) + F.col("p") / 2, "pos": F.sum("p").over(each), "neg": F.sum("q").over(each)})
    levels = levels.withColumn("u", F.sum(F.col("p") * F.col("below")).over(each))
    less_p = ratio(F.col("u") - F.col("below"), ((F.col("pos") - 1) * F.col("neg")).cast("double"))
    less_q = ratio(F.col("u") - F.col("above"), (F.col("pos") * (F.col("neg") - 1)).cast("double"))
    left = levels.select(*by, "pos", "neg", "u", F.explode(F.array(F.struct(F.col("p").alias("m"), less_p.alias("j")), F.struct(F.col("q").alias("m"), less_q.alias("j")))).alias("x")).select(*by, "pos", "neg", "u", "x.*")
    weight = F.when(F.col("j").isNotNull(), F.col("m")).otherwise(0)
    left = left.withColumn("d", ratio(F.sum(F.col("m") * F.col("j")).over(each), F.sum(weight).over(each).cast("double")) - F.col("j"))
    moment = lambda k: F.coalesce(F.sum(F.col("m") * F.pow("d", F.lit(float(k)))), F.lit(0.0))
    own = left.groupBy(*by).agg(F.first("pos").alias("pos"), F.first("neg").alias("neg"), F.first("u").alias("u"), moment(2).alias("s2"), moment(3).alias("s3"))
    auc = ratio(F.col("u"), (F.col("pos") * F.col("neg")).cast("double"))
    own = own.select(*by, (F.col("pos") + F.col("neg")).alias("n"), "pos", auc.alias("auc"), F.coalesce(ratio(F.col("s3"), 6 * F.pow("s2", F.lit(1.5))), F.lit(0.0)).alias("acceleration"))

    drawn = cells.select(*by, key, score, label, F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"))
    drawn = drawn.withColumn("c", poisson_one(hash_part(F.concat_ws("/", key, "replicate")) / float(2**32))).filter("c > 0")
    drawn = drawn.groupBy(*by, "replicate", score).agg(F.sum(F.col("c") * yes).alias("p"), F.sum(F.col("c") * no).alias("q"))
    got = own.join(_replicated_aucs(drawn, by, score), by, "left").withColumn("auc", F.when(F.col("boot").isNotNull(), F.col("auc")))
    return _bca_interval(got, by, F.lit(1e-6), alpha)


def _replicated_aucs(drawn: DataFrame, by: list[str], score: str) -> DataFrame:
    """``by, boot``: the AUCs of the replicates in order, from the numbers of positives and negatives at each score."""
    below = F.sum("q").over(Window.partitionBy(*by, "replicate").orderBy(score).rowsBetween(Window.unboundedPreceding, 0)) - F.col("q") / 2
    boot = drawn.withColumn("below", below).groupBy(*by, "replicate").agg(ratio(F.sum(F.col("p") * F.col("below")), (F.sum("p") * F.sum("q")).cast("double")).alias("b")).filter("b is not null")
    return boot.groupBy(*by).agg(F.array_sort(F.collect_list("b")).alias("boot"))  # at most one number a replicate


def _bca_interval(got: DataFrame, by: list[str], least: Column, alpha: float) -> DataFrame:
    """Interval from ``auc, acceleration, boot``; ``least``: smallest share of replicates below the AUC that counts."""
    share = F.size(F.filter("boot", lambda b: b < F.col("auc"))) / F.size("boot")
    got = got.withColumn("z0", normal_inverse(F.greatest(least, F.least(1 - least, share))))

    def bound(level: float) -> Column:
        z = F.col("z0") + NormalDist().inv_cdf(level)
        at = (F.size("boot") - 1) * normal_cdf(F.col("z0") + z / (1 - F.col("acceleration") * z))
        low = F.floor(at).cast("int")
        a, b = F.element_at("boot", low + 1), F.element_at("boot", F.least(low + 2, F.size("boot")))
        return F.when(F.col("auc").isNotNull(), a + (at - low) * (b - a))

    only = lambda c: F.when(F.col("auc").isNotNull(), F.col(c)).alias(c)
    return got.select(*by, "n", "pos", "auc", only("z0"), only("acceleration"), bound(alpha / 2).alias("lo"), bound(1 - alpha / 2).alias("hi"))


def _stratified_aucs(cells: DataFrame, by: list[str], score: str, label: str, key: str, replicates: int) -> DataFrame:
    """``by, boot``: the AUCs of the replicates in order, from ``cells`` with their ``place`` among the ``m`` of their class.

    A draw is never a row: a task draws for the cells that it has and hands on the places drawn, four bytes each, packed
    by class and replicate. What a replicate drew comes together with the order of the scores, of four bytes a cell.
    """
    of = {c: t for c, t in cells.dtypes if c in by}
    keys = ", ".join(f"`{c}` {t}" for c, t in of.items())
    ranked = cells.select(*by, F.col(label).cast("int").alias("y"), "place", F.col(key).cast("string").alias("key"), "m", F.dense_rank().over(Window.partitionBy(*by).orderBy(score)).alias("level"))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ends = [f"/{k}".encode() for k in range(1, replicates + 1)]
        for b in batches:
            for _, part in b.groupby([*by, "y"], dropna=False):
                starts, m = [k.encode() for k in part["key"]], part["m"].to_numpy(float)
                first = {c: part[c].iloc[0] for c in (*by, "y")}
                hashes = (np.frombuffer(b"".join([md5(s + e).digest()[:4] for s in starts]), ">u4") for e in ends)
                places = [np.floor(h / float(2**32) * m).astype("<i4").tobytes() for h in hashes]
                yield pd.DataFrame(first | {"replicate": range(1, replicates + 1), "places": places})

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        levels = [part[part.y == y].sort_values("place")["level"].to_numpy("<i4").tobytes() for y in (0, 1)]
        return pd.DataFrame({c: part[c].iloc[:1] for c in by} | {"no": levels[:1], "yes": levels[1:]})

    def auc(row: pd.DataFrame) -> pd.DataFrame:
        levels = [np.frombuffer(row[c].iloc[0], "<i4") for c in ("no", "yes")]
        n = 1 + max(int(x.max(initial=0)) for x in levels)
        q, p = (sum((np.bincount(x[np.frombuffer(d["places"], "<i4")], minlength=n) for d in row["drawn"].iloc[0] if d["y"] == y), np.zeros(n)) for y, x in enumerate(levels))
        pairs = p.sum() * q.sum()
        return pd.DataFrame({c: row[c] for c in by} | {"b": [float(p @ (q.cumsum() - q / 2) / pairs) if pairs else None]})

    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # the orders above lie in few tasks, the draws shall not
    ranked = materialise(ranked, "ranked")
    drawn = ranked.repartition(parts, "key").mapInPandas(draw, f"{keys}, y int, replicate int, places binary").groupBy(*by, "replicate").agg(F.collect_list(F.struct("y", "places")).alias("drawn"))
    packed = ranked.select(*by, "y", "place", "level").groupBy(*by).applyInPandas(pack, f"{keys}, no binary, yes binary")
    boot = drawn.join(F.broadcast(packed), by).groupBy(*by, "replicate").applyInPandas(auc, f"{keys}, b double").filter("b is not null")  # a row for each group
    return boot.groupBy(*by).agg(F.array_sort(F.collect_list("b")).alias("boot"))  # one number a replicate


def auc_bca_stratified(cells: DataFrame, by: list[str], score: str, label: str, key: str, replicates: int = 1000, alpha: float = 0.05) -> DataFrame:
    """As :func:`auc_bca`, drawing positives and negatives apart, as many of each as there are, and with the acceleration that the skewness of the replicates gives.

    Each cell of a class draws one of the class by an md5 hash of its key and the replicate, so that no replicate has
    one class only. Cells without a score or label are left out; with one class only all figures are NULL.
    """
    cells = cells.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
    kind = Window.partitionBy(*by, label)
    cells = cells.withColumn("place", F.row_number().over(kind.orderBy(key))).withColumn("m", F.count("*").over(kind))
    ranked = cells.withColumn("rank", average_rank(by, F.col(score)))
    own = ranked.groupBy(*by).agg(F.count("*").alias("n"), F.sum(label).alias("pos"), F.sum(F.when(F.col(label) == 1, F.col("rank")).otherwise(0.0)).alias("s"))
    n, pos = F.col("n"), F.col("pos")
    own = own.select(*by, "n", "pos", ratio(F.col("s") - pos * (pos + 1) / 2, (pos * (n - pos)).cast("double")).alias("auc"))
    got = own.join(_stratified_aucs(cells, by, score, label, key, replicates), by, "left").withColumn("auc", F.when(F.col("boot").isNotNull(), F.col("auc")))
    mean = F.aggregate("boot", F.lit(0.0), lambda s, b: s + b) / F.size("boot")
    got = got.withColumn("mean", mean)
    moment = lambda k: F.aggregate("boot", F.lit(0.0), lambda s, b: s + F.pow(F.col("mean") - b, F.lit(float(k))))
    got = got.withColumn("acceleration", F.when(F.col("boot").isNotNull(), F.coalesce(ratio(moment(3), 6 * F.pow(moment(2), F.lit(1.5))), F.lit(0.0))))
    return _bca_interval(got, by, 1 / (2.0 * F.size("boot")), alpha)


def bootstrap_weights(wide: DataFrame, models: tuple[str, str], by: list[str], replicates: int = 200) -> DataFrame:
    """Weight of the first of two models in their best convex combination over resampled series: mean, deviation, share at zero, extremes.

    Series are the blocks: each replicate weighs a series' sums by a Poisson(1) number from an md5 hash. With one
    weight w in [0, 1] for the first model and 1 - w for the second, the optimum is a ratio of two sums, clipped.
    """
    a, b, y = F.col(models[0]), F.col(models[1]), F.col("y_true")
    sums = wide.groupBy(*by, "container_id").agg(F.sum((a - b) * (y - b)).alias("top"), F.sum((a - b) * (a - b)).alias("bottom"))
    drawn = sums.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    count = poisson_one(hash_part(F.concat_ws("/", "container_id", "replicate")) / float(2**32))
    fits = drawn.groupBy(*by, "replicate").agg(F.sum(count * F.col("top")).alias("top"), F.sum(count * F.col("bottom")).alias("bottom"))
    fits = fits.select(*by, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(ratio(F.col("top"), F.col("bottom")), F.lit(0.5)))).alias("w"))
    return fits.groupBy(*by).agg(F.avg("w").alias("mean"), F.stddev_samp("w").alias("std"), F.avg((F.col("w") < 1e-6).cast("double")).alias("zero_share"), F.min("w").alias("least"), F.max("w").alias("most"))

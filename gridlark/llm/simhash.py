"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked exactly through vantage-point trees.

The tree's top is built on the driver from a bounded sample and sent to the executors; its leaves are shards. Leaves
that hold too many points are split again, round by round: executors sample each such leaf, grow a subtree for it and
deal its points anew, in parts that share no leaf's points between them by more than a salt. A point goes to the leaf on its side of each vantage radius; a point inside a ball and within ``radius`` of its shell
goes outside as well. By the triangle inequality any two points within ``radius`` of each other share a leaf, so
the pairs found leaf by leaf are all pairs, and nothing is compared across leaves. Inside a leaf the same splits go
on until the parts are small. A leaf reports a star of links for each of its components, never all of its pairs.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import connected_components, free_name, materialise, read_table, release_memory

#: Sample from which a tree's top is built, and leaves that it makes at most (a leaf has so much of the sample at least).
SAMPLE, SAMPLE_LEAVES = 16_384, 512
#: Distinct fingerprints that a shard should hold, and the size below which points are compared directly.
SHARD, DIRECT = 8_192, 192
#: A leaf of more than so many times a shard's points is split again; rounds at most; tasks that share a leaf's points then.
SLACK, ROUNDS, SALTS = 2, 8, 16


# ---------------------------------------------------------------- fingerprints
def simhash(text: str | None, width: int = 3) -> int:
    """Unsigned 64-bit fingerprint; 0 for a text without words."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
    n = max(1, len(words) - width + 1)
    h = np.fromiter(map(partial(xxh64_intdigest, seed=42), shingles), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 32_768):  # bounded memory for very long texts
        bits = np.unpackbits(h[i : i + 32_768].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > n).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprint_column(text: F.Column, width: int = 3) -> F.Column:
    """``text`` to its fingerprint as a signed long (the same 64 bits)."""

    @F.pandas_udf("long")
    def fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.fromiter((simhash(t, width) for t in texts), np.uint64, len(texts)).view(np.int64))
        release_memory()

    return fingerprints(text)


# ---------------------------------------------------------------- vantage-point tree
def _vantage(points: np.ndarray, radius: int) -> tuple[int, int] | None:
    """The vantage point and ball radius that send the fewest points both ways, among a few candidates with fair halves; None if there are none."""
    best, n = None, len(points)
    for v in points[np.linspace(0, n - 1, min(n, 12)).astype(int)]:
        count = np.bincount(np.bitwise_count(points ^ v), minlength=66).cumsum()
        for mu in range(1, 64):
            inside = int(count[mu])
            if 0.2 * n <= inside <= 0.8 * n:
                twice = inside - (int(count[mu - radius]) if mu >= radius else 0)
                worst = max(inside, n - inside + twice)
                if worst <= 0.9 * n and (best is None or (worst + twice) < best[0]):
                    best = (worst + twice, v, mu)
    return None if best is None else (best[1], best[2])


def build_top(sample: np.ndarray, depth: int, radius: int, least: int) -> list:
    """Nodes in depth-first order: ``("split", vantage, mu, left, right)`` or ``("leaf", number)``."""
    nodes, leaves = [], 0

    def grow(points: np.ndarray, left: int) -> int:
        nonlocal leaves
        at = len(nodes)
        nodes.append(None)
        cut = _vantage(points, radius) if left > 0 and len(points) >= 2 * least else None
        if cut is None:
            nodes[at] = ("leaf", leaves)
            leaves += 1
        else:
            d = np.bitwise_count(points ^ cut[0])
            # the sample is split without the overlap: it only places the cuts
            nodes[at] = ("split", int(cut[0]), cut[1], grow(points[d <= cut[1]], left - 1), grow(points[d > cut[1]], left - 1))
        return at

    grow(sample, depth)
    return nodes


def assign(points: np.ndarray, nodes: list, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Leaf numbers and points; points near a shell come more than once."""
    leaf, got, todo = [], [], [(0, points)]
    while todo:
        at, p = todo.pop()
        if not len(p):
            continue
        if nodes[at][0] == "leaf":
            leaf.append(np.full(len(p), nodes[at][1], np.int32))
            got.append(p)
        else:
            _, v, mu, left, right = nodes[at]
            d = np.bitwise_count(p ^ np.uint64(v)).astype(np.int16)
            todo += [(left, p[d <= mu]), (right, p[d > mu - radius])]
    if not leaf:
        return np.zeros(0, np.int32), np.zeros(0, np.uint64)
    return np.concatenate(leaf), np.concatenate(got)


def _grow_components(points: np.ndarray, radius: int, union) -> None:
    """Union of all pairs within ``radius``: spreads from seeds and never compares points that are joined already."""
    left = points
    while len(left) > 1:
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            block, front = front[:128], front[128:]
            near = np.bitwise_count(block[:, None] ^ left[None, :]) <= radius
            hit = near.any(axis=0)
            if hit.any():
                union(block[near[:, hit].argmax(axis=0)], left[hit])
                front, left = np.concatenate([front, left[hit]]), left[~hit]


def leaf_links(points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """``(point, smallest point of its component in this leaf)`` for points that have a partner."""
    points = np.unique(points)
    parent = np.arange(len(points))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def union(a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(np.searchsorted(points, a).tolist(), np.searchsorted(points, b).tolist(), strict=True):
            x, y = find(x), find(y)
            if x != y:
                parent[max(x, y)] = min(x, y)

    todo = [points]
    while todo:
        p = todo.pop()
        cut = _vantage(p, radius) if len(p) > DIRECT else None
        if cut is None:
            _grow_components(p, radius, union)
        else:
            d = np.bitwise_count(p ^ cut[0]).astype(np.int16)
            todo += [p[d <= cut[1]], p[d > cut[1] - radius]]
    root = np.fromiter((find(i) for i in range(len(points))), np.int64, len(points))
    linked = np.bincount(root, minlength=len(points))[root] > 1
    return points[linked], points[root[linked]]


# ---------------------------------------------------------------- Spark job
def _split_again(points: DataFrame, sizes: DataFrame, radius: int, shard: int, sample: int, level: int) -> tuple[DataFrame, DataFrame]:
    """Points of oversized leaves in the leaves of a subtree for each, and the ``leaf`` of those that can't be split.

    ``points``: ``leaf, fp``; ``sizes``: ``leaf, n``. Points and a leaf's subtree meet in tasks by leaf and salt, the
    subtree first, so a task holds a batch of points and one subtree.
    """

    def grow(b: pd.DataFrame) -> pd.DataFrame:
        depth = int(np.ceil(np.log2(max(2, b.n.iloc[0] / shard))))
        nodes = build_top(np.unique(b.fp.to_numpy(np.int64)).view(np.uint64), depth, radius, max(4, sample // SAMPLE_LEAVES))
        return pd.DataFrame({"leaf": b.leaf.iloc[:1], "parts": [sum(n[0] == "leaf" for n in nodes)], "nodes": [pickle.dumps(nodes)]})

    sampled = points.join(sizes, "leaf").filter(F.pmod(F.xxhash64("fp", F.lit(level)), F.col("n")) < sample)
    trees = materialise(sampled.groupBy("leaf").applyInPandas(grow, "leaf long, parts int, nodes binary"), "vp-trees")
    whole = trees.filter("parts = 1").select("leaf")
    trees = trees.filter("parts > 1").withColumn("first", F.sum("parts").over(Window.orderBy("leaf").rowsBetween(Window.unboundedPreceding, -1)))
    trees = trees.select("leaf", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.coalesce("first", F.lit(0)).alias("first"), "nodes", F.lit(0).cast("long").alias("fp"))  # no nulls: pandas would make floats of them
    dealt = points.join(whole, "leaf", "left_anti").select("leaf", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int").alias("salt"), F.lit(0).cast("long").alias("first"), F.lit(None).cast("binary").alias("nodes"), "fp")
    both = trees.unionByName(dealt).repartition("leaf", "salt").sortWithinPartitions("leaf", "salt", F.col("nodes").isNull())

    def descend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, nodes = 0, []
        for b in batches:
            for _, g in b.groupby(["leaf", "salt"], sort=True):
                if g.nodes.iloc[0] is not None:
                    first, nodes, g = int(g["first"].iloc[0]), pickle.loads(g.nodes.iloc[0]), g.iloc[1:]
                leaf, p = assign(g.fp.to_numpy(np.int64).view(np.uint64), nodes, radius)
                yield pd.DataFrame({"leaf": leaf.astype(np.int64) + first, "fp": p.view(np.int64)})

    return materialise(both.mapInPandas(descend, "leaf long, fp long"), "vp-points"), whole


def dealt_points(distinct: DataFrame, radius: int = 2, shard: int = SHARD, sample: int = SAMPLE) -> DataFrame:
    """``level, leaf, fp``: the fingerprints of ``distinct.fp`` in leaves of at most ``SLACK * shard`` points, if these can be split so far.

    Fingerprints within ``radius`` bits of one another share a leaf (``level`` and ``leaf`` name it).
    """
    total = distinct.count()
    depth = max(0, int(np.ceil(np.log2(max(1, total) / shard))))
    rows = distinct.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(sample).collect() if depth else []
    nodes = build_top(np.array([r.fp for r in rows], np.int64).view(np.uint64), depth, radius, max(4, sample // SAMPLE_LEAVES))

    def to_leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            leaf, p = assign(b.fp.to_numpy(np.int64).view(np.uint64), nodes, radius)
            yield pd.DataFrame({"leaf": leaf.astype(np.int64), "fp": p.view(np.int64)})

    points, done = materialise(distinct.select("fp").mapInPandas(to_leaves, "leaf long, fp long"), "vp-points"), []
    for level in range(ROUNDS):
        large = materialise(points.groupBy("leaf").agg(F.count("*").alias("n")).filter(F.col("n") > SLACK * shard), "vp-large")
        if large.isEmpty():
            break
        done.append(points.join(large, "leaf", "left_anti").select(F.lit(level).alias("level"), "leaf", "fp"))
        more = points.join(large, "leaf", "left_semi")
        split, whole = _split_again(more, large, radius, shard, sample, level)
        done.append(more.join(whole, "leaf", "left_semi").select(F.lit(level).alias("level"), "leaf", "fp"))
        points = split
    for part in done:
        points = points if "level" in points.columns else points.select(F.lit(ROUNDS).alias("level"), "leaf", "fp")
        points = points.unionByName(part)
    return points if "level" in points.columns else points.select(F.lit(ROUNDS).alias("level"), "leaf", "fp")


def fingerprint_links(distinct: DataFrame, radius: int = 2, shard: int = SHARD, sample: int = SAMPLE) -> DataFrame:
    """``node, root`` (signed longs) of the fingerprints in ``distinct.fp`` that are within ``radius`` bits of another, directly or by a chain."""

    def links(b: pd.DataFrame) -> pd.DataFrame:
        p, root = leaf_links(b.fp.to_numpy(np.int64).view(np.uint64), radius)
        return pd.DataFrame({"fp": p.view(np.int64), "root": root.view(np.int64)})

    stars = dealt_points(distinct, radius, shard, sample).groupBy("level", "leaf").applyInPandas(links, "fp long, root long")
    stars = materialise(stars, "vp-stars")
    # a point that several leaves hold ties their stars together; the graph of the stars' roots is much the smaller one
    per = stars.groupBy("fp").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    ties = stars.join(per.filter("low <> high"), "fp").select(F.col("root").alias("src"), F.col("low").alias("dst"))
    roots = connected_components(ties)
    top = roots.select(F.col("node").alias("low"), "root")
    return per.select(F.col("fp").alias("node"), "low").join(top, "low", "left").select("node", F.coalesce("root", "low").alias("root"))


def _components(prints: DataFrame, radius: int, shard: int, sample: int) -> DataFrame:
    """``fp, component_id`` for the fingerprints of ``prints`` (``id, fp``)."""
    distinct = materialise(prints.groupBy("fp").agg(F.min("id").alias("low_id")), "simhash-distinct")
    roots = materialise(fingerprint_links(distinct, radius, shard, sample), "simhash-roots")
    named = roots.join(distinct, roots.node == distinct.fp).select("fp", "root", "low_id")
    low = named.groupBy("root").agg(F.min("low_id").alias("component"))
    linked = named.join(low, "root").select("fp", "component")
    # every fingerprint is named here once, so that a null component is not mistaken for an unlinked one
    return distinct.join(linked.withColumn("linked", F.lit(True)), "fp", "left").select("fp", F.when(F.col("linked"), F.col("component")).otherwise(F.col("low_id")).alias("component_id"))


def _prints(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    return materialise(docs.select(F.col(id_col).alias("id"), fingerprint_column(F.col(text_col), width).alias("fp")), "simhash")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, width: int = 3, shard: int = SHARD, sample: int = SAMPLE) -> DataFrame:
    """Near-duplicate classes of ``docs``: ``<id_col>, fp long, component_id``.

    Texts are lower-cased in A-Z, cut into words at ASCII white space, and hashed by ``width``-word shingles,
    repeats included; fingerprints within ``radius`` bits link. ``component_id`` is the smallest id of the
    component. Null and empty texts have fingerprint 0 and link with one another. Repeated rows come back as often
    as they came in. A null id belongs to its text's component but is never its smallest id, unless the component has
    no other (then ``component_id`` is null). An empty table gives an empty result. Other columns are not carried.
    """
    prints = _prints(docs, id_col, text_col, width)
    return prints.join(_components(prints, radius, shard, sample), "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, width: int = 3) -> DataFrame:
    """``docs`` with one row for each near-duplicate component: the row with the smallest id. Columns, whatever their names, stay as they are.

    Null and empty texts are one component. Of repeated rows with the smallest id and its fingerprint one stays. Rows
    without an id give way to any row with one. An empty table gives an empty result. Texts are fingerprinted once;
    only those whose id comes more than once are tagged a second time.
    """
    prints = _prints(docs, id_col, text_col, width)
    low = prints.join(_components(prints, radius, SHARD, SAMPLE), "fp").filter(F.col("id").eqNullSafe(F.col("component_id"))).select("id", "fp").distinct()
    times = prints.groupBy("id").agg(F.count("*").alias("times"))
    name, mark = free_name(docs, "keep_id"), free_name(docs, "keep_fp")
    keep = materialise(low.join(times, low["id"].eqNullSafe(times["id"])).select(low["id"].alias(name), F.col("fp").alias(mark), "times"), "simhash-keep")
    once = keep.filter(F.col("times") == 1).filter(F.col(name).isNotNull())
    kept = docs.join(once, docs[id_col] == once[name], "left_semi")
    several = keep.filter((F.col("times") > 1) | F.col(name).isNull())
    if several.isEmpty():
        return kept
    # rows whose ids say too little: told apart by fingerprint, and one of each is taken before the shuffle's end
    rows = docs.join(several.select(name).distinct(), docs[id_col].eqNullSafe(F.col(name)), "left_semi").select(F.struct("*").alias("row"))
    tagged = rows.select("row", F.col("row").getField(id_col).alias(name), fingerprint_column(F.col("row").getField(text_col), width).alias(mark))
    tagged = tagged.join(several, tagged[name].eqNullSafe(several[name]) & (tagged[mark] == several[mark]), "left_semi")
    firsts = tagged.groupBy(name, mark).agg(F.min_by("row", F.xxhash64(F.col("row").getField(text_col))).alias("row"))
    return kept.unionByName(firsts.select("row.*"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: fingerprint and component of every document."""
    out = simhash_components(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

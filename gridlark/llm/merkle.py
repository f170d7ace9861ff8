"""Merkle manifest of a dataset: a digest for each row, a tree for each part, a root over the parts, a proof for each row.

Digests are computed where rows are read; only they are sorted and numbered. A part's leaves lie in superblocks of
2^12. Each superblock is reduced to its node, and these nodes are leaves of the next tree up, until a part has one
superblock; so no group is larger than a superblock, whatever a part holds. On the way down each superblock is
cogrouped with the one row it needs from outside: the siblings of its node up to the root. There the local reduction
is done, proofs are joined and folded.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, read_table
from .crc_sql import crc_of, crc_tables

#: Levels of a superblock; columns of a leaf, and the one whose values the parts are.
LEVELS, FIELDS, PART = 12, ("doc_id", "source", "lang", "n_chars", "text"), "lang"
#: Rows are tampered with where this divides the checksum of their id.
EVERY = 7


def digest(*parts: str) -> str:
    """SHA-256 of the joined digests, in hexadecimal."""
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(columns: list[F.Column]) -> F.Column:
    """Digest of a row: each value as byte count, colon and value, a dash for null."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


# ---------------------------------------------------------------- order
def numbered(rows: DataFrame, part: str, order: list[str]) -> DataFrame:
    """``rows`` with ``pos`` (long): the row's number in its part by ``order``, from 0. Nothing passes through one task.

    Rows are dealt by ranges, numbered within each range's file and shifted by the counts of the ranges before.
    """
    sorted_ = rows.repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), part, *order).sortWithinPartitions(part, *order)
    sorted_ = materialise(sorted_.withColumn("at", F.monotonically_increasing_id()).withColumn("range", F.shiftright("at", 33)), "sorted")
    counts = sorted_.groupBy("range", part).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy(part).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range at most
    shifts = counts.withColumn("shift", F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).select("range", part, "shift")
    return sorted_.join(shifts, ["range", part]).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "range", "shift")


# ---------------------------------------------------------------- trees
def reduced(nodes: list[str], levels: int | None) -> list[list[str]]:
    """The nodes and what becomes of them level by level: ``levels`` times, or until one is left (None)."""
    out = [nodes]
    while len(out) <= levels if levels is not None else len(out[-1]) > 1:
        last = out[-1]
        out.append([digest(*last[i : i + 2]) for i in range(0, len(last), 2)])
    return out


def siblings(tree: list[list[str]], i: int) -> list[str]:
    """Of leaf ``i`` of a tree, level by level: the other node of its run, "" where there is none."""
    out = []
    for level in tree[:-1]:
        out.append(level[i ^ 1] if i ^ 1 < len(level) else "")
        i >>= 1
    return out


def fold(node: str, at: int, proof: list[str]) -> str:
    """The node above all of ``proof`` for a node at place ``at`` of the lowest level."""
    for other in proof:
        node = digest(node) if not other else digest(other, node) if at & 1 else digest(node, other)
        at >>= 1
    return node


def _levels(n: int, levels: int) -> int | None:
    """A superblock of a part with more than one is reduced ``levels`` times, even if it holds fewer nodes."""
    return levels if n > 1 << levels else None


def _block_node(rows: pd.DataFrame, levels: int) -> pd.DataFrame:
    nodes = rows.sort_values("pos")
    tree = reduced(nodes["node"].tolist(), _levels(int(rows["n"].iloc[0]), levels))
    return pd.DataFrame({"part": rows["part"].iloc[:1], "pos": [int(rows["pos"].iloc[0]) >> levels], "node": [tree[-1][0]]})


def _block_proofs(rows: pd.DataFrame, outer: pd.DataFrame, levels: int) -> pd.DataFrame:
    rows = rows.sort_values("pos", ignore_index=True)
    tree, above, top = reduced(rows["node"].tolist(), _levels(int(rows["n"].iloc[0]), levels)), list(outer["proof"].iloc[0]), outer["top"].iloc[0]
    return pd.DataFrame({"part": rows["part"], "pos": rows["pos"], "proof": [siblings(tree, i) + above for i in range(len(rows))], "top": top})


def _blocks(nodes: DataFrame, levels: int) -> DataFrame:
    return nodes.withColumn("block", F.shiftright("pos", levels))


def superblock_proofs(nodes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """``part, pos, proof, top`` for the superblocks of ``nodes`` (``part, pos, node, n``; ``n``: nodes of the part).

    ``proof``: siblings of the superblock's node up to the part's top node, ``top``. Superblock by superblock of
    superblocks, one more at each call.
    """
    own = materialise(_blocks(nodes, levels).groupBy("part", "block").applyInPandas(partial(_block_node, levels=levels), "part string, pos long, node string"), "nodes")
    counts = nodes.groupBy("part").agg(F.max("n").alias("n")).withColumn("n", F.ceil(F.col("n") / (1 << levels)).cast("long"))
    if own.groupBy("part").count().filter("count > 1").isEmpty():
        return own.select("part", "pos", F.array().cast("array<string>").alias("proof"), F.col("node").alias("top"))
    own = materialise(own.join(counts, "part"), "nodes")
    outer = superblock_proofs(own, levels)
    cogrouped = _blocks(own, levels).groupBy("part", "block").cogroup(outer.withColumnRenamed("pos", "block").groupBy("part", "block"))
    return materialise(cogrouped.applyInPandas(partial(_block_proofs, levels=levels), "part string, pos long, proof array<string>, top string"), "outer")


def _finish(rows: pd.DataFrame, outer: pd.DataFrame, levels: int) -> pd.DataFrame:
    """Rows of a superblock with what they need from outside it: proofs, and what their present digests fold to."""
    rows, o = rows.sort_values("pos", ignore_index=True), outer.iloc[0]
    tree, above, parts = reduced(rows["node"].tolist(), _levels(int(rows["n"].iloc[0]), levels)), list(o["proof"]), list(o["part_proof"])
    proofs, folded = [], []
    for i, (pos, present) in enumerate(zip(rows["pos"].tolist(), rows["present"].tolist(), strict=True)):
        own = siblings(tree, i) + above
        proofs.append(own + parts)
        folded.append(fold(fold(present, pos, own), int(o["part_pos"]), parts))
    return pd.DataFrame({"doc_id": rows["doc_id"], "part": rows["part"], "pos": rows["pos"], "leaf": rows["node"], "subroot": o["top"], "root": o["root"], "proof": proofs, "folded_root": folded})


MANIFEST = "doc_id string, part string, pos long, leaf string, subroot string, root string, proof array<string>, folded_root string"


def manifest(rows: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Proofs of all ``rows``: ``doc_id, part, leaf, present`` (digests as recorded and as found now).

    Gives ``doc_id, part, pos, leaf, subroot, root, proof, folded_root``. In a part leaves ascend by ``doc_id`` (nulls
    first), then by ``leaf``; equal rows follow one another, each with a place and a proof of its own. ``proof``: the siblings from the leaf to the root, "" where a run has one node. ``part`` must not be
    null; ``doc_id`` may be of any type that sorts. An empty table gives an empty result.
    """
    kind = rows.schema["doc_id"].dataType
    # equal rows get a number, so that a range never has to hold all of them
    rows = rows.select("part", "doc_id", "leaf", "present", F.monotonically_increasing_id().alias("tie"))
    at = numbered(rows, "part", ["doc_id", "leaf", "tie"])
    counts = at.groupBy("part").agg(F.count("*").alias("n"))
    nodes = materialise(at.join(counts, "part").select("part", "pos", "n", F.col("leaf").alias("node"), "present", F.col("doc_id").cast("string").alias("doc_id")), "leaves")
    outer = superblock_proofs(nodes.select("part", "pos", "node", "n"), levels)
    tops = outer.filter("pos = 0").select("part", "top")
    parts = numbered(tops.select(F.lit("").alias("part"), F.col("top").alias("node"), F.col("part").alias("own")), "part", ["own"])
    parts = materialise(parts.join(parts.groupBy("part").agg(F.count("*").alias("n")), "part"), "parts")
    over = superblock_proofs(parts.drop("own"), levels)
    of_parts = _blocks(parts, levels).groupBy("part", "block").cogroup(over.withColumnRenamed("pos", "block").groupBy("part", "block"))
    of_parts = of_parts.applyInPandas(partial(_part_proofs, levels=levels), "part string, part_pos long, part_proof array<string>, root string")
    outer = outer.join(of_parts, "part").withColumnRenamed("pos", "block")
    done = _blocks(nodes, levels).groupBy("part", "block").cogroup(outer.groupBy("part", "block")).applyInPandas(partial(_finish, levels=levels), MANIFEST)
    return done.withColumn("doc_id", F.col("doc_id").cast(kind))


def _part_proofs(rows: pd.DataFrame, outer: pd.DataFrame, levels: int) -> pd.DataFrame:
    rows = rows.sort_values("pos", ignore_index=True)
    found = _block_proofs(rows, outer, levels)
    return pd.DataFrame({"part": rows["own"], "part_pos": found["pos"], "part_proof": found["proof"], "root": found["top"]})


def verify(proofs: DataFrame) -> DataFrame:
    """``proofs`` with ``verified``: whether what a row holds now still gives the root."""
    return proofs.withColumn("verified", F.col("folded_root") == F.col("root"))


def _part(column: F.Column) -> F.Column:
    """"=" and the value, "" for null: so nulls come first, and values bytewise."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit(""))


def leaves(docs: DataFrame, fields: tuple[str, ...] = FIELDS, part: str = PART, id_col: str = "doc_id") -> DataFrame:
    """``part, doc_id, leaf, present`` of every row as it stands: what :func:`manifest` takes."""
    own = leaf([F.col(f) for f in fields])
    return docs.select(_part(F.col(part)).alias("part"), F.col(id_col).alias("doc_id"), own.alias("leaf")).withColumn("present", F.col("leaf"))


def tampered_leaves(docs: DataFrame, every: int = EVERY) -> DataFrame:
    """As :func:`leaves`, but ``present`` is the digest with 1 added to ``n_chars`` where ``every`` divides the checksum of the id. Rows without an id are left alone."""
    own = docs.select(*FIELDS).withColumn("leaf", leaf([F.col(f) for f in FIELDS]))
    changed = leaf([F.col(f).cast("decimal(20,0)") + 1 if f == "n_chars" else F.col(f) for f in FIELDS])
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0, F.lit(False))
    return own.select(_part(F.col(PART)).alias("part"), "doc_id", "leaf", F.when(hit, changed).otherwise(F.col("leaf")).alias("present"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: manifest of all documents, with some rows tampered with."""
    proofs = verify(manifest(materialise(tampered_leaves(read_table(spark, sf_dir, "documents")), "digests")))
    return proofs.select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join("proof", ""), 256).alias("proof_sha256"), "folded_root", "verified")


_VALUES = {"doc_id": "doc_id::VARCHAR", "source": "source", "lang": "lang", "n_chars": "n_chars::VARCHAR", "text": "text"}
_LEAF = "sha256(" + " || ".join(f"coalesce(strlen({v})::VARCHAR || ':' || {v}, '-')" for v in _VALUES.values()) + ")"


def _tree(name: str, leaves: str) -> str:
    """CTE ``name (level, part, pos, node, n)`` over ``leaves (part, pos, node, n)``."""
    return f"""
{name}(level, part, pos, node, n) AS (
  SELECT 0, part, pos, node, n FROM {leaves}
  UNION ALL
  SELECT level + 1, part, pos // 2, sha256(node || other), (n + 1) // 2 FROM (
    SELECT *, coalesce(lead(node) OVER (PARTITION BY part ORDER BY pos), '') AS other FROM {name} WHERE n > 1) q WHERE pos % 2 = 0)"""


ORACLE = f"""
WITH RECURSIVE {crc_tables("SELECT max(strlen(doc_id::VARCHAR)) FROM documents")},
ids AS (SELECT doc_id::VARCHAR AS s FROM documents WHERE doc_id IS NOT NULL),
crcs AS ({crc_of("ids")}),
own AS (SELECT doc_id, coalesce('=' || lang, '') AS part, {_LEAF} AS leaf, {_LEAF.replace("n_chars", "(n_chars + 1)")} AS changed FROM documents),
leaves AS MATERIALIZED (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, leaf AS node, count(*) OVER (PARTITION BY part) AS n, doc_id,
    CASE WHEN crc % 7 = 0 THEN changed ELSE leaf END AS present
  FROM own LEFT JOIN crcs ON s = doc_id::VARCHAR),
{_tree("tree", "leaves")},
nodes AS MATERIALIZED (SELECT * FROM tree),
subroots AS MATERIALIZED (SELECT '' AS part, row_number() OVER (ORDER BY part) - 1 AS pos, node, count(*) OVER () AS n, part AS own FROM nodes WHERE n = 1),
{_tree("upper", "subroots")},
over_nodes AS MATERIALIZED (SELECT * FROM upper),
steps AS MATERIALIZED (
  SELECT l.part, l.pos, t.level, (l.pos >> t.level) % 2 AS side, o.node AS other
  FROM leaves l JOIN (SELECT DISTINCT part, level FROM nodes WHERE n > 1) t ON t.part = l.part
  LEFT JOIN nodes o ON o.part = l.part AND o.level = t.level AND o.pos = xor(l.pos >> t.level, 1)
  UNION ALL
  SELECT l.part, l.pos, 100 + t.level, (p.pos >> t.level) % 2, o.node
  FROM leaves l JOIN subroots p ON p.own = l.part CROSS JOIN (SELECT DISTINCT level FROM over_nodes WHERE n > 1) t
  LEFT JOIN over_nodes o ON o.level = t.level AND o.pos = xor(p.pos >> t.level, 1)),
numbered AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY part, pos ORDER BY level) AS step FROM steps),
folds(part, pos, step, node) AS (
  SELECT part, pos, 0, present FROM leaves
  UNION ALL
  SELECT f.part, f.pos, s.step, sha256(CASE WHEN side = 1 THEN coalesce(other, '') || node ELSE node || coalesce(other, '') END)
  FROM folds f JOIN numbered s ON s.part = f.part AND s.pos = f.pos AND s.step = f.step + 1),
ends AS (SELECT part, pos, max_by(node, step) AS folded FROM folds GROUP BY part, pos),
proofs AS (SELECT part, pos, coalesce(string_agg(other, '' ORDER BY level), '') AS proof FROM steps GROUP BY part, pos)
SELECT l.doc_id, l.node AS leaf, p.node AS subroot, r.node AS root, sha256(coalesce(proof, '')) AS proof_sha256, folded AS folded_root, folded = r.node AS verified
FROM leaves l JOIN subroots p ON p.own = l.part CROSS JOIN (SELECT node FROM over_nodes WHERE n = 1) r
JOIN ends e ON e.part = l.part AND e.pos = l.pos LEFT JOIN proofs f ON f.part = l.part AND f.pos = l.pos
"""

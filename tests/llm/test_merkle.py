"""op13: leaves, roots, proofs and tampering against a plain version, with superblocks of a few leaves."""

import hashlib
import zlib

import pytest

from gridlark.llm import merkle

ROW = "doc_id long, text string, lang string, source string, n_chars long"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    values = [doc_id, source, lang, n_chars, text]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 2])) for i in range(0, len(out[-1]), 2)])
    return out


def path(tree, i):
    out = []
    for level in tree[:-1]:
        other = i + 1 if i % 2 == 0 else i - 1
        out.append((level[other] if other < len(level) else None, i % 2))
        i //= 2
    return out


def plain(rows):
    parts = {}
    for r in rows:
        parts.setdefault(r[2], []).append(r)
    names = sorted(parts, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for name in names:
        parts[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        trees[name] = levels([leaf(*r) for r in parts[name]])
    top = levels([trees[name][-1][0] for name in names])
    out = []
    for p, name in enumerate(names):
        for i, r in enumerate(parts[name]):
            steps = path(trees[name], i) + path(top, p)
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            node = leaf(*r[:4], None if r[4] is None else r[4] + 1) if hit else leaf(*r)
            for other, right in steps:
                node = sha(node if other is None else other + node if right else node + other)
            root = top[-1][0]
            out.append((str(r[0]), leaf(*r), trees[name][-1][0], root, sha("".join(o for o, _ in steps if o)), node, node == root))
    return sorted(out)


def found(spark, rows, depth, schema=ROW, shape=lambda df: df):
    df = shape(spark.createDataFrame(rows, schema))
    m = merkle.verify(merkle.manifest(merkle.tampered_leaves(df), levels=depth))
    assert m.columns[0] == "doc_id"
    return sorted((str(r.doc_id), r.leaf, r.subroot, r.root, sha("".join(r.proof)), r.folded_root, r.verified) for r in m.collect())


def corpus(n):
    langs = ["en", "en", "en", "de", "fr", None, "é", "zz"]
    return [(k * 3 % 1009, f"text {k} é", langs[k * k % 8] if k % 5 else "en", f"s{k % 3}" if k % 4 else None, k if k % 11 else None) for k in range(n)]


@pytest.mark.parametrize("n", [1, 2, 3, 150])
def test_against_plain(spark, n):
    got = found(spark, corpus(n), 2)
    assert got == plain(corpus(n))
    assert n < 10 or 0 < sum(not r[-1] for r in got) < n


def test_deep_and_flat(spark):
    """Superblocks of two leaves: a tree of many levels; of 4,096: one superblock a part."""
    rows = corpus(60)
    assert found(spark, rows, 1) == found(spark, rows, 12) == plain(rows)


def test_odd_rows(spark):
    rows = [(None, None, None, None, None), (None, None, None, None, None), (1, "", "", "", 0), (1, "", "", "", 0), (1, "b", "", "s", -1), (14, "x" * 300_000, "en", "s", 9_223_372_036_854_775_807), *((k, "t", "en", "s", 1) for k in range(40))]
    assert found(spark, rows, 1, shape=lambda df: df.selectExpr("*", "1 as leaf", "2 as part", "3 as POS", "4 as node", "5 as tie")) == plain(rows)
    assert merkle.verify(merkle.manifest(merkle.tampered_leaves(spark.createDataFrame([], ROW)))).count() == 0


def test_any_table(spark):
    """Other fields, string ids: nothing tampered, all verified; one altered row is found, and only it."""
    df = spark.createDataFrame([(f"k{k:03d}", k % 3, k / 7) for k in range(90)], "name string, shard int, value double")
    rows = merkle.leaves(df, ("name", "value"), "shard", "name")
    good = merkle.verify(merkle.manifest(rows, levels=2))
    assert good.count() == good.filter("verified").count() == 90 and good.select("root").distinct().count() == 1
    from pyspark.sql import functions as F

    bad = rows.withColumn("present", F.when(F.col("doc_id") == "k041", F.sha2(F.lit("other"), 256)).otherwise(F.col("present")))
    assert [r.doc_id for r in merkle.verify(merkle.manifest(bad, levels=2)).filter("not verified").collect()] == ["k041"]

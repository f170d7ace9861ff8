import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from gridlark.llm import simhash as S


def brute(texts):
    """Fingerprints by the definition, one shingle at a time."""
    out = []
    for t in texts:
        words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or "")) if w]
        sh = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        hs = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in sh]
        out.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)))
    return out


def closure(prints, ids):
    comp = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = comp[i], comp[j]
                comp = [b if c == a else c for c in comp]
    low = {}
    for c, i in zip(comp, ids, strict=True):
        low[c] = min([x for x in (low.get(c), i) if x is not None], default=None)
    return [low[c] for c in comp]


def test_fingerprint_by_definition():
    texts = [None, "", " \t\n", "one", "ONE two", "a b c", "a b c d e É é\x85x\xa0y", "x " * 70_000]
    assert [S.simhash(t) for t in texts[:-1]] == brute(texts[:-1])
    assert S.simhash("x " * 70_000) == S.simhash("x x x")


def test_tree_finds_every_pair():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    near = base[:900] ^ (np.uint64(1) << rng.integers(0, 64, 900).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 900).astype(np.uint64))
    dense = np.uint64(12345) ^ rng.integers(0, 2**12, 700, dtype=np.uint64)
    p = np.unique(np.concatenate([base, near, dense]))
    nodes = S.build_top(p[::7], 4, 2, least=8)
    leaf, got = S.assign(p, nodes, 2)
    assert set(got.tolist()) == set(p.tolist()) and leaf.max() >= 3 and len(got) < 3 * len(p)
    links = []
    for k in range(leaf.max() + 1):
        a, r = S.leaf_links(got[leaf == k], 2)
        links += zip(a.tolist(), r.tolist(), strict=True)
    parent = {x: x for x in p.tolist()}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, r in links:
        a, r = find(a), find(r)
        parent[max(a, r)] = min(a, r)
    d = np.bitwise_count(p[:, None] ^ p[None, :]) <= 2
    want = {x: x for x in p.tolist()}

    def root(x):
        while want[x] != x:
            x = want[x]
        return x

    for i, j in zip(*np.nonzero(np.triu(d, 1)), strict=True):
        a, b = root(int(p[i])), root(int(p[j]))
        want[max(a, b)] = min(a, b)
    assert {x: find(x) for x in parent} == {x: root(x) for x in want}


def test_components_against_brute_force(spark):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    texts = [None, "", "  ", "only two"] + [" ".join(rnd.choices(words, k=rnd.randint(3, 90))) for _ in range(60)]
    texts += [t + " tail" for t in texts[10:40]] + [texts[5]] * 20 + ["only two", "Only TWO"]
    rows = [(i * 3 + 1, t, 7, "c") for i, t in enumerate(texts)] + [(None, texts[5], 7, "c"), (None, "by itself here", 7, "c"), (16, texts[5], 7, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int, component_id string")
    want = closure(brute([r[1] for r in rows]), [r[0] for r in rows])
    for shard in (8192, 16):
        got = S.simhash_components(docs, shard=shard).collect()
        assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == sorted((str(r[0]), str(c)) for r, c in zip(rows, want, strict=True))
    kept = S.keep_one(docs.withColumnsRenamed({"fp": "keep_id", "component_id": "Row"}).withColumn("keep_fp", F.lit(1)).withColumn("__fp", F.lit(2)).withColumn("__n", F.lit(3)))
    assert set(map(tuple, kept.select("keep_id", "Row", "keep_fp", "__fp", "__n").collect())) == {(7, "c", 1, 2, 3)}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted({str(c) for c in want})
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted({str(c) for c in want})


def test_large_leaves_are_split_again(spark):
    """The top alone (a sample of 64 points) can't make small leaves; further rounds do, and lose no link."""
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**63, 4000, dtype=np.uint64)
    near = base[:500] ^ (np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64))
    p = np.unique(np.concatenate([base, near])).view(np.int64)
    frame = spark.createDataFrame([(int(x),) for x in p], "fp long")
    dealt = S.dealt_points(frame, shard=100, sample=64)
    sizes = [r.n for r in dealt.groupBy("level", "leaf").agg(F.count("*").alias("n")).collect()]
    assert max(sizes) <= S.SLACK * 100 and dealt.select("level").distinct().count() >= 2
    got = {r.node: r.root for r in S.fingerprint_links(frame, shard=100, sample=64).collect()}
    d = np.bitwise_count(p.view(np.uint64)[:, None] ^ p.view(np.uint64)[None, :]) <= 2
    pairs = [(int(p[i]), int(p[j])) for i, j in zip(*np.nonzero(np.triu(d, 1)), strict=True)]
    assert set(got) == {x for pair in pairs for x in pair}
    assert all(got[a] == got[b] for a, b in pairs)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert S.simhash_components(docs).count() == 0 and S.keep_one(docs).count() == 0

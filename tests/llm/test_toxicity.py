import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from gridlark.llm import toxicity as T


def corpus(n=1500):
    rnd = random.Random(2)
    plain, bad = [f"w{i}" for i in range(300)], ["vile", "scumbag", "moron"]
    docs, labels = [], []
    for i in range(n):
        words = rnd.choices(plain, k=rnd.randint(5, 200))
        toxic = i % 7 == 0
        if toxic:
            for b in rnd.choices(bad, k=3):
                words.insert(rnd.randrange(len(words)), b)
        docs.append((i, " ".join(words), 0.5))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_held_out_accuracy_and_odd_rows(spark):
    docs, labels = corpus()
    odd = [(5000, None, 0.5), (5001, "", 0.5), (5002, "x " * 200_000, 0.5), (None, docs[0][1], 0.5), docs[0], docs[0]]
    frame = spark.createDataFrame(docs + odd, "doc_id long, text string, score double").withColumn("__score", F.lit(7)).withColumn("id", F.lit("x"))
    known = spark.createDataFrame([*labels, (None, 1, 1), (3, None, None), (1, 1, 0)], "doc_id long, quality int, toxic int")
    got = T.score_documents(frame, known).collect()
    assert len(got) == len(docs) + len(odd)
    truth = {i: t for i, _, t in labels}
    held = [(r.score, r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    assert all(r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in got)
    right = sum(p == t for _, p, t in held)
    assert right >= 0.97 * len(held) and not any(p and not t for _, p, t in held)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add(r.score)
    assert by[5000] == by[5001] and by[None] == by[0] and len(by[0]) == 1
    kept = T.drop_toxic(frame, known)
    assert kept.columns == frame.columns and kept.count() == sum(not r.predicted for r in got)


def test_state_against_the_formulas():
    f = T.Ftrl(bits=4)
    sets = [np.array([1, 3]), np.array([3]), np.array([1, 2])] * 9
    z, n = np.zeros(17), np.zeros(17)
    for k, s in enumerate(sets):
        at, y = [*s, 16], k % 2
        w = {i: 0.0 if abs(z[i]) <= (T.L1 if i < 16 else 0) else -(z[i] - np.sign(z[i]) * (T.L1 if i < 16 else 0)) / ((T.BETA + n[i] ** 0.5) / T.ALPHA + T.L2) for i in at}
        g = 1 / (1 + np.exp(-sum(w.values()))) - y
        for i in at:
            sigma = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / T.ALPHA
            z[i] += g - sigma * w[i]
            n[i] += g * g
        f.learn(s, y)
    assert np.allclose(f.z, z) and np.allclose(f.n, n)


def plain_fit(docs, labels, keys, bits, passes, parts):
    """The averaged passes written out over dictionaries. ``keys``: id -> (hash for the part, hash for the order)."""
    toxic = {i: y for i, _, y in labels if zlib.crc32(str(i).encode()) % 3 != 1}
    dealt = [sorted((i for i in toxic if keys[i][0] % parts == p), key=lambda i: (keys[i][1], keys[i][0])) for p in range(parts)]
    sets = {i: [*T.coordinates(t, bits).tolist(), 2**bits] for i, t, *_ in docs}
    z, n = {}, {}
    for turn in range(passes):
        got = []
        for p, ids in enumerate(dealt):
            pz, pn = dict(z), dict(n)
            for k in np.random.default_rng([turn, p]).permutation(len(ids)) if ids else ():
                at, y = sets[ids[k]], toxic[ids[k]]
                w = {}
                for i in at:
                    l1 = T.L1 if i < 2**bits else 0
                    v = pz.get(i, 0.0)
                    w[i] = 0.0 if abs(v) <= l1 else -(v - np.sign(v) * l1) / ((T.BETA + pn.get(i, 0.0) ** 0.5) / T.ALPHA + T.L2)
                g = 1 / (1 + np.exp(-np.clip(sum(w.values()), -35, 35))) - y
                for i in at:
                    m = pn.get(i, 0.0)
                    pz[i] = pz.get(i, 0.0) + g - ((m + g * g) ** 0.5 - m**0.5) / T.ALPHA * w[i]
                    pn[i] = m + g * g
            got += [(pz, pn)] if ids else []
        z, n = ({i: sum(s[k].get(i, 0.0) for s in got) / len(got) for i in set().union(*(s[k] for s in got))} for k in (0, 1))
    out = {i: 0.0 if abs(v) <= (l1 := T.L1 if i < 2**bits else 0) else -(v - np.sign(v) * l1) / ((T.BETA + n[i] ** 0.5) / T.ALPHA + T.L2) for i, v in z.items()}
    return {i: w for i, w in out.items() if w or i == 2**bits}


def test_fit_against_plain_averaged_passes(spark):
    docs, labels = corpus(300)
    frame, known = spark.createDataFrame(docs, "doc_id long, text string, score double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    keys = {r.doc_id: (r.a, r.b) for r in frame.selectExpr("doc_id", "xxhash64(doc_id) a", "xxhash64(doc_id, 2) b").collect()}
    at, w = T.fit(frame, known, bits=12, passes=3)
    want = plain_fit(docs, labels, keys, 12, 3, T.PARTS)
    assert at.tolist() == sorted(want)
    assert np.allclose(w, [want[i] for i in at.tolist()], rtol=1e-3, atol=1e-4)


def test_fit_does_not_depend_on_partitions_or_batches(spark):
    docs, labels = corpus(400)
    frame, known = spark.createDataFrame(docs, "doc_id long, text string, score double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes")
    before = [spark.conf.get(n) for n in names]
    models = []
    try:
        for parts, values in ((1, ("10", "3", "1000")), (16, ("10000", "9", "128m"))):
            for n, v in zip(names, values, strict=True):
                spark.conf.set(n, v)
            models.append(T.fit(frame.repartition(parts), known.repartition(parts), passes=3))
    finally:
        for n, v in zip(names, before, strict=True):
            spark.conf.set(n, v)
    assert all(np.array_equal(a, b) for a, b in zip(*models, strict=True)) and len(models[0][0]) > 2


def test_repeated_ids_count_once(spark):
    docs, labels = corpus(200)
    frame, known = spark.createDataFrame(docs * 3, "doc_id long, text string, score double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert T.labelled_rows(frame, known, 50).count() == 50


def test_packed_coordinates_come_back():
    for bits in (4, 16, 19):
        at = np.unique(np.random.default_rng(bits).integers(0, 2**bits, 300))
        assert np.array_equal(T.unpack_coordinates(T.pack_coordinates(at, bits), bits), at)
    assert len(T.unpack_coordinates(T.pack_coordinates(np.zeros(0, np.int64), 19), 19)) == 0


def test_coordinates_by_definition(monkeypatch):
    text = "A b, c b a É-é c " * 5
    want = T.coordinates(text)
    monkeypatch.setattr(T, "SLICE", 3)
    assert np.array_equal(T.coordinates(text), want)
    assert len(T.coordinates(None)) == len(T.coordinates(" .,")) == 0 and len(T.coordinates("one")) == 1


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, toxic int")
    assert T.score_documents(docs, labels).count() == 0
    one = spark.createDataFrame([(1, "a")], docs.schema)
    assert T.score_documents(one, labels).first().score == 0.5

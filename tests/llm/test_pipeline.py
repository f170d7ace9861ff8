"""The pipeline stage by stage on rows with oddities, each stage against a plain version over what the one before kept."""

import hashlib
import random

import corpus_pipeline as P
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from gridlark.llm import bpe, mixing, simhash, toxicity
from gridlark.llm.common import materialise


def tables(spark, folder):
    rnd = random.Random(6)
    words, bad = [f"w{i}" for i in range(400)], ["vile", "scumbag", "moron"]
    rows, labels = [], []
    for i in range(500):
        text = rnd.choices(words, k=rnd.randint(8, 80))
        if i % 6 == 0:
            for b in rnd.choices(bad, k=4):
                text.insert(rnd.randrange(len(text)), b)
        rows.append((i, " ".join(text), "en", "abc"[i % 3]))
        labels.append((i, 1, int(i % 6 == 0)))
    rows += [(1000 + i, rows[7][1], None, "a") for i in range(20)]  # copies of a clean text
    rows += [(2000, None, "en", "a"), (2001, "", None, None), (2002, "  ", "en", "b"), (None, rows[8][1] + " more", "en", "b"), rows[9], rows[9]]
    rows += [(2003, "the token=abcdef123456 is set in " + " ".join(words[:30]), "en", None), (2004, "x " * 60_000, "en", "c")]
    docs = [(i, t, lang, s, None if t is None else len(t), f"row{k}", k) for k, (i, t, lang, s) in enumerate(rows)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, row string, __n int")
    frame.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return {i for i, _, y in labels if y}


def test_stages_one_after_another(spark, tmp_path):
    folder = f"file://{tmp_path}"
    toxic = tables(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in P.STAGES[:-1]:
        out = materialise(stage(spark, docs, folder), f"test-{name}")
        assert out.columns == docs.columns
        kept[name] = (docs.collect(), out.collect())
        docs = out

    before, after = kept["toxicity"]
    ids = {r.doc_id for r in after}
    clean = [r.doc_id for r in before if r.doc_id not in toxic]
    assert all(i in ids for i in clean) and len(toxic & ids) <= 0.15 * len(toxic)  # learnt from some 56 toxic rows
    at, weights = toxicity.fit(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    weight = dict(zip(at.tolist(), weights.tolist(), strict=True))
    score = {r.row: sum(weight.get(i, 0.0) for i in [*toxicity.coordinates(r.text).tolist(), at[-1]]) for r in before}
    assert {r.row for r in after} == {row for row, s in score.items() if s < np.log(toxicity.THRESHOLD / (1 - toxicity.THRESHOLD))}
    assert {tuple(r) for r in after} <= {tuple(r) for r in before}

    before, after = kept["simhash_near_dedup"]
    prints = [simhash.simhash(r.text) for r in before]
    group = list(range(len(before)))
    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 2 and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    low = {}
    for g, r in zip(group, before, strict=True):
        low[g] = min((x for x in (low.get(g), r.doc_id) if x is not None), default=None)
    assert sorted(str(r.doc_id) for r in after) == sorted(map(str, low.values()))

    before, after = kept["secret_scans"]
    was = {r.row: r for r in before}
    assert len(before) == len(after)
    for r in after:
        old = was[r.row]
        if old.text and "token=" in old.text:
            assert r.text == old.text.replace("token=abcdef123456", "[secret]") and r.n_chars == len(r.text)
        else:
            assert tuple(r) == tuple(old)

    before, after = kept["source_mix"]
    counts = {(r.doc_id, r.size): r.copies for r in mixing.mix(spark.createDataFrame(before, docs.schema)).collect()}
    times = {}
    for r in after:
        times[r.row] = times.get(r.row, 0) + 1
    for r in before:
        size = len((r.text or "").split())
        assert times.get(r.row, 0) == (counts[r.doc_id, size] if size else 0)

    lib = Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))
    lib.no_truncation()
    lib.no_padding()
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in P.STAGES[-1][1](spark, docs, folder).collect())
    want = []
    for r in after:
        ids = lib.encode(r.text, add_special_tokens=False).ids
        digest = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), lib.decode(ids, skip_special_tokens=False))]
        want.append((str(r.doc_id), len(ids), *digest))
    assert got == sorted(want)


def test_empty_tables(spark, tmp_path):
    folder = f"file://{tmp_path}"
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert P.run(spark, folder).count() == 0

import random

import numpy as np
import public_tokenizers
import pytest
from gridlark.llm import packing as P

ENC = P.encoder(public_tokenizers.path(P.VOCABULARY))


def brute(sizes, row):
    rooms, rows = [], []
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        fit = min((r for r in rooms if r >= sizes[k]), default=None)
        if fit is None:
            rooms.append(row - sizes[k])
            rows.append(sizes[k])
        else:
            i = rooms.index(fit)
            rooms[i] -= sizes[k]
            rows[i] += sizes[k]
    return sorted(rows)


@pytest.mark.parametrize("row", [1, 7, 64, 100])
def test_packing_against_a_plain_search(row):
    rnd = random.Random(row)
    for n in (0, 1, 5, 300):
        sizes = [rnd.randint(0, row) for _ in range(n)]
        got = P.best_fit_decreasing(sizes, row)
        assert sorted(k for r in got for k in r) == list(range(n))
        assert sorted(sum(sizes[k] for k in r) for r in got) == brute(sizes, row)


def test_round_trip(spark):
    rnd = random.Random(2)
    texts = [None, "", "a", "word " * 9000, "<|endoftext|> is text", "é🙂" * 40] + [" ".join(rnd.choices(["alpha", "beta", "of", "thing"], k=rnd.randint(0, 300))) for _ in range(200)]
    rows = [(i, t, 3, "c") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int, parts string").repartition(3)
    packs = P.pack_documents(docs, row=128).cache()
    for p in packs.collect():
        ids = np.frombuffer(p.ids, "<u2")
        assert len(ids) == 128 and p.cu_seqlens[-1] == p.n_tokens and p.position_resets == p.cu_seqlens[:-1]
        assert (ids[p.n_tokens :] == P.PAD).all() and len(p.doc_ids) == len(p.position_resets)
    got = {r.doc_id: r.ids for r in P.unpack(packs).collect()}
    assert got == {i: ENC.encode_ordinary(t or "") for i, t, *_ in rows}
    used = sum(len(x) for x in got.values())
    assert packs.count() <= -(-used // 128) * 1.02 + 3
    ids = [r.pack_id for r in packs.collect()]
    assert len(ids) == len(set(ids))
    assert {r.doc_key for r in P.unpack(packs).collect()} == {k for p in packs.collect() for k in p.doc_keys}
    odd = P.pack_documents(spark.createDataFrame([(None, "a b"), (1, "c"), (1, "c")], "doc_id long, text string").coalesce(1)).collect()
    assert sorted(map(str, odd[0].doc_ids)) == ["1", "1", "None"] and len(odd) == 1


@pytest.mark.parametrize("kind", ["long", "string"])
def test_repeated_and_null_ids_come_back_from_written_matrices(spark, tmp_path, kind):
    ids = [None, None, 1, 1, 2**60 + 1] if kind == "long" else [None, None, "a", "a", "b'1"]
    texts = ["a b", "c d " * 90, "a b", "other " * 200, ""]
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), f"doc_id {kind}, text string").repartition(2)
    P.write_packs(P.pack_documents(docs, row=64), f"file://{tmp_path}/packs")
    packs = spark.read.parquet(f"file://{tmp_path}/packs")
    assert all(len(p.ids) == 128 for p in packs.collect())
    got = sorted((str(r.doc_id), r.ids) for r in P.unpack(packs).collect())
    assert got == sorted((str(i), ENC.encode_ordinary(t)) for i, t in zip(ids, texts, strict=True))


def test_empty_table(spark):
    assert P.pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0

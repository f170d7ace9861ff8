"""op12: first-fit decreasing against a plain version, whole documents from their pieces, padding, the library's ids."""

import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from gridlark.llm import first_fit
from gridlark.llm.packing import encoder

ROW = "doc_id long, text string"


def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_tournament_is_first_fit():
    r = random.Random(3)
    for n in (1, 2, 7, 300):
        sizes = [r.randint(1, 64) for _ in range(n)]
        bins, room = [], []
        for k in sorted(range(n), key=lambda k: -sizes[k]):
            at = next((i for i, x in enumerate(room) if x >= sizes[k]), None)
            if at is None:
                bins.append([])
                room.append(64)
                at = len(bins) - 1
            bins[at].append(k)
            room[at] -= sizes[k]
        assert first_fit.first_fit_decreasing(sizes, 64) == bins


def test_cuts():
    r = random.Random(4)
    for n in (0, 1, 2, 30, 500):
        sizes = [r.choice([1, 3, 40, 41, 63, 64, r.randint(1, 64)]) for _ in range(n)]
        out = first_fit.cut_and_fill(first_fit.first_fit_decreasing(sizes, 64), sizes, 64, 2)
        covered = [[] for _ in sizes]
        for parts in out:
            total = sum(p[2] for p in parts)
            assert 0 < total <= 64 and first_fit.padding(total, 64) <= 2
            for k, at, m in parts:
                covered[k].append((at, m))
        for k, size in enumerate(sizes):
            ends = 0
            for at, m in sorted(covered[k]):
                assert at == ends and m > 0
                ends += m
            assert ends == size
        assert sum(len(c) - 1 for c in covered) <= len(out) + 6  # a room takes one cut at most


def docs():
    r = random.Random(8)
    words = "the of and river stone über naïve Straße 12 345 don't we'll x".split()
    out = [(k, " ".join(r.choice(words) for _ in range(r.choice([0, 3, 80, 700, 1500])))) for k in range(120)]
    return [*out, (7, None), (None, ""), (None, "a"), (None, "a"), (5, "<|endoftext|>so<|endoftext|>"), (6, "  中文\x85 b\x1cc ا \U0001f600"), (8, "ab" * 20_000), (9, "x y " * 30_000)]


def test_pieces_hold_every_id_once(spark):
    rows, lib = docs(), library()
    df = spark.createDataFrame(rows, ROW).selectExpr("*", "1 as ids", "2 as length", "'x' as `group`").repartition(3)
    pieces = first_fit.pack_first_fit(df, group=50).collect()
    found, sequences = {}, {}
    for p in pieces:
        found.setdefault(p.doc_key, []).append(p)
        sequences.setdefault(p.sequence_id, []).append(p)
    got = []
    for parts in found.values():
        parts.sort(key=lambda p: p.start)
        ids = np.concatenate([np.frombuffer(p.ids, "<u2") for p in parts]).tolist()
        assert [p.start for p in parts] == np.cumsum([0] + [p.length for p in parts])[:-1].tolist() and {p.doc_tokens for p in parts} == {len(ids)}
        assert all(p.ids_crc32 == zlib.crc32(np.frombuffer(p.ids, "<u2").astype("<u4").tobytes()) for p in parts)
        got.append((str(parts[0].doc_id), ids))
    assert sorted(got) == sorted((str(k), [*lib.encode(t or "", add_special_tokens=False).ids, 0]) for k, t in rows)
    pad = total = 0
    for parts in sequences.values():
        parts.sort(key=lambda p: p.offset)
        assert [p.offset for p in parts] == np.cumsum([0] + [p.length for p in parts])[:-1].tolist()
        n = sum(p.length for p in parts)
        assert n <= 1024
        pad, total = pad + first_fit.padding(n, 1024), total + n
    assert pad <= 0.004 * total and len(sequences) <= total / 1024 + 8 * 10


def test_matrices(spark):
    df = spark.createDataFrame(docs(), ROW)
    pieces = first_fit.pack_first_fit(df, row=256)
    packed = first_fit.sequences(pieces, row=256).collect()
    assert all(len(p.ids) == 2 * (p.n_tokens + first_fit.padding(p.n_tokens, 256)) and p.cu_seqlens[-1] == p.n_tokens for p in packed)
    back = {}
    for p in packed:
        ids = np.frombuffer(p.ids, "<u2")
        for key, start, a, b in zip(p.doc_keys, p.starts, p.cu_seqlens, p.cu_seqlens[1:], strict=False):
            back.setdefault(key, {})[start] = ids[a:b].tolist()
    got = sorted(sum((v for _, v in sorted(x.items())), []) for x in back.values())
    lib = library()
    assert got == sorted([*lib.encode(t or "", add_special_tokens=False).ids, 0] for _, t in docs())


def test_odd_tables(spark):
    assert first_fit.pack_first_fit(spark.createDataFrame([], ROW)).count() == 0
    same = spark.createDataFrame([("k", "same text")] * 3, "doc_id string, text string")
    rows = first_fit.pack_first_fit(same, with_ids=False).collect()
    assert {r.doc_id for r in rows} == {"k"} and len({r.doc_key for r in rows}) == 3 and {r.doc_tokens for r in rows} == {3}
    assert sorted(sum(r.length for r in rows if r.sequence_id == s) for s in {r.sequence_id for r in rows}) == [1, 8]  # no padding


def test_ranks_give_the_library_s_ids():
    """Every code point that is not sent to the library, in several surroundings."""
    lib, ranks = library(), encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    plain = [chr(c) for c in range(0x2100) if not first_fit._odd().search(chr(c))]
    assert len(plain) > 500
    texts = [form.format(c) for c in plain for form in ("a{0}b", " {0} ", "1{0}2", "x {0}{0}  {0}'s", "\n{0}\t{0}ll", "{0}")]
    assert [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)] == [ranks.encode_ordinary(t) for t in texts]

import hashlib
import random

import numpy as np
import pytest
from gridlark.llm import quartile_digest as Q


def brute_codes(text, bits=Q.BITS):
    b = b"\0\0" + text.encode() + b"\0\0"
    count = [0] * 2**bits
    for i in range(len(b) - 2):
        x = b[i] | b[i + 1] << 8 | b[i + 2] << 16
        count[(x * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - bits)] += 1
    s = sorted(count)
    q = [s[len(s) * k // 4 - 1] for k in (1, 2, 3)]
    return Q._length_code(len(b) - 4), np.array([sum(c > x for x in q) for c in count])


def rows():
    rnd = random.Random(8)
    texts = [None, "", "a", "ab", "é" * 5, "x" * 3000, "🙂b" * 77] + ["".join(rnd.choices("abcdefgh é", k=rnd.randint(0, 400))) for _ in range(120)]
    return [(7 * i % 1009, t, 1, "c") for i, t in enumerate(texts)] + [(None, "no id", 1, "c"), (14, "twice", 1, "c"), (14, "twice", 1, "c")]


def test_codes_by_definition(monkeypatch):
    for t in ("", "a", "hello world " * 30, "é🙂" * 50):
        a, b = Q.codes(t), brute_codes(t)
        assert a[0] == b[0] and np.array_equal(a[1], b[1])
        back = Q.undigest(Q.digest(a))
        assert back[0] == a[0] and np.array_equal(back[1], a[1]) and Q.likeness(a, back) == 1
    long = "word " * 5000
    want = Q.digest(Q.codes(long))
    monkeypatch.setattr(Q, "SLICE", 17)
    assert Q.digest(Q.codes(long)) == want
    assert 0 <= Q.likeness(Q.codes(""), Q.codes(long)) < 1


def test_every_row_meets_its_successor(spark):
    data = rows()
    docs = spark.createDataFrame(data, "doc_id long, text string, n_chars int, fingerprint string").repartition(5)
    got = {}
    for r in Q.fingerprint_documents(docs).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == len(data)
    once = sorted((r for r in data if r[0] is not None and r[0] != 14), key=lambda r: r[0])
    following = {a[0]: b for a, b in zip(once, once[1:], strict=False) if not a[0] < 14 < b[0]}
    assert len(following) > 100
    for i, t, *_ in once:
        if i not in following:
            continue
        text, other = t or "", following[i][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        (r,) = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint == Q.digest(brute_codes(text)) and r.edited_fingerprint == Q.digest(brute_codes(edited))
        assert r.near_edited == pytest.approx(Q.likeness(Q.codes(text), Q.codes(edited))) and r.near_next == pytest.approx(Q.likeness(Q.codes(text), Q.codes(other)))
    (last,) = got[once[-1][0]]
    t, first = once[-1][1] or "", "no id"
    assert last.edited_sha256 == hashlib.sha256(Q.edit(t, first).encode()).hexdigest()
    (none,) = got[None]
    assert none.edited_sha256 == hashlib.sha256(Q.edit("no id", data[0][1] or "").encode()).hexdigest()


def test_small_tables(spark):
    assert Q.fingerprint_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    (r,) = Q.fingerprint_documents(spark.createDataFrame([(5, "abcd")], "doc_id long, text string")).collect()
    assert r.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and r.near_next == 1

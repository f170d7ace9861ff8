import json
import random

import numpy as np
import public_tokenizers
import pytest
from gridlark.llm import token_counts as T
from tokenizers import Tokenizer

PATH = public_tokenizers.path(T.VOCABULARY)


def texts():
    rnd = random.Random(1)
    pool = "abcdefghij theTHE'stmre'lld  \n\t\r0123456789.,!?éÉßçñÜİΣσς的字ﬁ²½é  ​🙂-_'''vle"
    out = ["", "   ", " ", "\n", "don't we'll 'S I'M '' 're'r 'v 'l", "<|endoftext|>", "a <|endoftext|>\n <|endoftext|>  c<|endof", " \n\n x  \n", "x" * 5000, "ab " * 4000, " " * 700 + "a", "a'r", "a 'r", "'ve'v"]
    out += ["".join(rnd.choices(pool, k=rnd.randint(1, 300))) for _ in range(400)]
    return out + ["".join(chr(c) for c in (rnd.choices(range(1, 0xD800), k=40))) for _ in range(200)]


def library(ts):
    lib = Tokenizer.from_file(PATH)
    return [len(lib.encode(t or "", add_special_tokens=False).ids) for t in ts]


def test_same_counts_as_the_library():
    ts = texts()
    want = library(ts)
    for block, chunk in ((T.BLOCK, T.CHUNK), (300, 7), (64, 16)):
        got = T.TokenCounter(PATH, block, chunk).counts([*ts, None]).tolist()
        bad = [(t, a, b) for t, a, b in zip(ts, got, want, strict=False) if a != b]
        assert not bad, bad[:3]
        assert got[-1] == 0


def test_states_may_be_forgotten(monkeypatch):
    ts = texts()[:200]
    monkeypatch.setattr(T, "STATES", 20)
    monkeypatch.setattr(T, "REMEMBERED", 20)
    monkeypatch.setattr(T, "PAIRS", 20)
    assert T.TokenCounter(PATH).counts(ts).tolist() == library(ts)


def test_prefix_scan_gives_the_sequential_run():
    rng = np.random.default_rng(3)
    classes = rng.integers(0, 12, 5000).astype(np.uint8)
    state, begins = T.FRESH, set()
    for i, c in enumerate(classes.tolist()):
        state, out = T._step(state, c)
        if out & T.HERE:
            begins.add(i)
        if out & T.BEFORE:
            begins.add(i - 1)
    for chunk in (1, 3, 64, 5000, 9999):
        assert set(T.word_starts(classes, chunk).tolist()) == begins


def test_rows(spark):
    rows = [(1, None, 4), (1, "a b", 4), (None, "é", 4), (2, "", 4), (3, "word " * 50_000, 4)]
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in T.count_tokens(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")).collect())
    want = library([r[1] for r in rows])
    assert got == sorted((str(i), len((t or "").encode()), n, n > 1024) for (i, t, _), n in zip(rows, want, strict=True))
    assert T.count_tokens(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_other_vocabularies_are_refused(tmp_path):
    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    T.check_vocabulary(spec)
    changes = [{"pre_tokenizer": spec["pre_tokenizer"] | {"add_prefix_space": True}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": None}, {"normalizer": {"type": "NFC"}}, {"model": spec["model"] | {"ignore_merges": True}}, {"model": spec["model"] | {"end_of_word_suffix": "</w>"}}]
    for k, change in enumerate(changes):
        path = tmp_path / f"{k}.json"
        path.write_text(json.dumps(spec | change), encoding="utf-8")
        with pytest.raises(ValueError, match="plain byte-level"):
            T.TokenCounter(str(path))
    with pytest.raises(ValueError, match="plain byte-level"):
        T.TokenCounter(public_tokenizers.path("word_bpe_49k.json"))

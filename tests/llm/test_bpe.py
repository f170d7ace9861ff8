import hashlib
import random

import public_tokenizers
from gridlark.llm import bpe as B
from tokenizers import Tokenizer

PATH = public_tokenizers.path(B.VOCABULARY)


def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def texts():
    rnd = random.Random(1)
    pool = "abcdefghij theTHE'stmre'll  \n\t0123456789.,!?éÉßçñÜİΣσς的字ﬁ²½é  ​🙂-_"
    out = ["", "   ", "don't we'll 'S I'M", "<|endoftext|>", "a<|startoftext|>B <|endoftext|>c<|endof", "ΑΣ ΑΣΑ", "x" * 5000, "ab " * 4000, "İstanbul ǅ ẞ"]
    out += ["".join(rnd.choices(pool, k=rnd.randint(1, 300))) for _ in range(400)]
    return out + ["".join(chr(c) for c in (rnd.choices(range(1, 0xD800), k=40))) for _ in range(200)]


def test_same_ids_and_text_as_the_library():
    lib, own = library(), B.WordBpe(PATH)
    for t in texts():
        want = lib.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == want, t
        assert own.decode(want) == lib.decode(want, skip_special_tokens=False)


def test_a_merge_that_opens_a_lower_rank():
    # (1,2) -> 9 has rank 5, yet (9,3) has rank 1 and must come before the second (1,2)
    merges = [(90, 91, 92), (9, 3, 8), (8, 1, 7), (93, 94, 95), (96, 97, 98), (1, 2, 9)]
    ranks = {B.pair_code(a, b): rank for rank, (a, b, _) in enumerate(merges)}
    assert B.merge_by_pair_index([[1, 2, 3, 1, 2], [1, 2], []], ranks, merges) == [[7, 2], [9], []]


def test_forgetting_changes_nothing(monkeypatch):
    own = B.WordBpe(PATH)
    want = [own.encode(t) for t in texts()]
    monkeypatch.setattr(B, "REMEMBERED", 30)
    monkeypatch.setattr(B, "SLICE", 7)
    assert [B.WordBpe(PATH).encode(t) for t in texts()[:50]] == want[:50]


def test_rows(spark):
    rows = [(1, None, 4), (1, "a b", 4), (None, "A b", 4), (2, "", 4), (3, "word " * 50_000, 4)]
    got = {(r.doc_id, r.n_tokens): r for r in B.encode_documents(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert set(got) == {(1, 0), (1, 2), (None, 2), (2, 0), (3, 50_000)}
    assert got[1, 0].ids_sha256 == got[2, 0].decoded_sha256 == empty and got[1, 2].ids_sha256 == got[None, 2].ids_sha256
    docs = spark.createDataFrame([(1, "Round trip, DON'T!")], "doc_id long, text string")
    back = docs.select(B.decode_column(PATH, B.encode_column(PATH, docs.text)).alias("t")).first().t
    assert back == library().decode(library().encode("Round trip, DON'T!", add_special_tokens=False).ids, skip_special_tokens=False)
    assert B.encode_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0

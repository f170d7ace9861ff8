"""op11: near words, forms and roots against a plain version; hot groups, long words, odd rows."""

import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd

from gridlark.llm import spelling

ROW = "doc_id long, text string"


def plain_words(docs, shortest=5, least=3):
    n = Counter()
    for id_, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda x: x[0].lower(), run)
            h = zlib.crc32(f"{'' if id_ is None else id_}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= shortest and k >= least}


def one_edit(x, y):
    x, y = sorted((x, y), key=len)
    if len(y) - len(x) > 1 or x == y:
        return False
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y, strict=True)) == 1
    return any(y[:i] + y[i + 1 :] == x for i in range(len(y)))


def plain(docs):
    n, out = plain_words(docs), {}
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return sorted(out.values())


def rows(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def corpus(seed=5, docs=60, alphabet="abcéÀZ"):
    g = np.random.default_rng(seed)
    stems = ["".join(g.choice(list(alphabet), int(g.integers(4, 9)))) for _ in range(150)]
    out = []
    for k in range(docs):
        words = g.choice(stems, 120).tolist()
        for i in g.integers(0, 120, 15):
            w, at = words[i], int(g.integers(0, len(words[i])))
            words[i] = [w[:at] + w[at + 1 :], w[:at] + "x" + w[at:], w[:at] + "y" + w[at + 1 :]][int(g.integers(3))]
        out.append((k, "".join(w + str(g.choice([" ", ", ", "-", "œ", "7", "\n"])) for w in words)))
    return out


def test_against_plain(spark):
    docs = corpus()
    assert rows(spelling.spelling_variants(spark.createDataFrame(docs, ROW))) == plain(docs)


def test_hot_groups_are_split(spark):
    """With groups of a few words all paths are taken, and tiles of a few rows cut the rest."""
    docs = corpus(seed=9, alphabet="ab")
    want = plain(docs)
    assert max(r[4] for r in want) > 8
    assert rows(spelling.spelling_variants(spark.createDataFrame(docs, ROW), group=4, tile=3)) == want


def test_chain_of_forms(spark):
    chain = [("abcdefgh", 3), ("abcdefgx", 8), ("abcdefyx", 20), ("abcdezyx", 45), ("abcdwzyx", 100), ("abcqwzyx", 230)]
    docs = [(None, " ".join(w for w, n in chain for _ in range(n)))]
    want = plain(docs)
    assert len(want) == 6 and {r[2] for r in want} == {"abcqwzyx"}
    assert rows(spelling.spelling_variants(spark.createDataFrame(docs, ROW))) == want


def test_odd_rows(spark):
    long = "ab" * 20_000
    docs = [(1, None), (2, ""), (None, "Wordy wordy WORDY wordt wordt wordt"), (3, f"{long} {long}c {long}"), (4, f"{long}c {long} {long}c {long}c"), (4, f"{long}"), (4, f"{long}")]
    df = spark.createDataFrame(docs, ROW).selectExpr("doc_id", "text", "1 as word", "2 as n", "3 as key", "4 as form")
    got = rows(spelling.spelling_variants(df))
    assert got == plain(docs) and {len(r[0]) for r in got} >= {5, 40_000, 40_001}
    assert spelling.spelling_variants(spark.createDataFrame([], ROW)).count() == 0
    assert rows(spelling.spelling_variants(spark.createDataFrame([(str(a), b) for a, b in corpus(docs=20)], "doc_id string, text string"))) == plain(corpus(docs=20))


def test_compare():
    words = sorted({"".join(np.random.default_rng(k).choice(list("ab"), 3 + k % 4)) for k in range(60)})
    i, j, prefix = spelling.compare([w.encode() for w in words], [w.encode() for w in words])
    found = {(words[a], words[b]) for a, b in zip(i, j, strict=True)}
    assert found == {(a, b) for a in words for b in words if a == b or one_edit(a, b)}
    assert all(words[a][:p] == words[b][:p] and words[a][p : p + 1] != words[b][p : p + 1] or a == b for a, b, p in zip(i, j, prefix, strict=True))


def test_no_pairs():
    assert spelling._near(pd.DataFrame({"word": ["abcde"], "n": [3], "m": [5], "a": [2], "b": [0], "key": [1]}), 4) is None

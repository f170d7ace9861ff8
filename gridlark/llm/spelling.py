"""Spelling variants: words of a corpus that are one edit apart, by dense prefix-suffix tiling.

Two different words are one inserted, deleted or replaced code point apart exactly if their common prefix and their
common suffix together reach the longer length less one. Words meet in groups of those that may be: a group has the
length ``m`` of the longer word and holds words of ``m`` and ``m - 1`` code points that agree on their first ``a`` and
last ``b`` code points. At first one half of the word is agreed on; a group of too many words is dealt into two again
(agree on half of what is left at the front, or at the back), until groups are small or a single position is left,
where no more than an alphabet's words fit. Each pair has one path through these choices, given by its common
prefix, so it is met exactly once, and no group is compared that is larger than a few tiles.

Groups lie side by side in tiles of padded code-point matrices. A pair of tiles is compared column by column from the
left and from the right, all words against all.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, read_table
from .crc_sql import crc_of, crc_tables

#: Words of a tile; words and code points above which a group is dealt into two.
TILE, GROUP, CELLS = 256, 1_024, 4_000_000
#: Distinct words that a counting task holds before it hands its counts on.
HELD = 200_000
#: Rows of a table of group keys that is sent to all executors (16 bytes each); a larger one is joined by a shuffle.
SENT = 50_000
#: A run is deleted one of its code points where this divides its hash.
EVERY = 97
#: Latin-1 bytes: letters of a run stay, A-Z in lower case, all else parts runs.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


# ---------------------------------------------------------------- words
def runs(text: str) -> list[bytes]:
    """Maximal runs of A-Z, a-z and U+00C0 to U+00FF as Latin-1 bytes, A-Z in lower case. Other code points become '?', which parts runs."""
    return text.encode("latin-1", "replace").translate(_LETTERS).split()


def altered(run: bytes, crc: int, every: int) -> bytes:
    """The run, or what is left of it without one code point where ``every`` divides the hash. ``crc``: that of what stands before the run."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), crc)
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _counter(every: int, shortest: int):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[bytes, int] = {}

        def ready() -> pd.DataFrame:
            frame = pd.DataFrame({"word": [w.decode("latin-1") for w in held], "n": np.fromiter(held.values(), np.int64, len(held))})
            held.clear()
            return frame

        for b in batches:
            for id_, text in zip(b.id, b.text, strict=True):
                crc = zlib.crc32(f"{'' if id_ is None else id_}:".encode())
                for run, n in Counter(runs(text or "")).items():
                    if len(run) >= shortest:
                        word = altered(run, crc, every)
                        if len(word) >= shortest:
                            held[word] = held.get(word, 0) + n
                if len(held) >= HELD:
                    yield ready()
        if held:
            yield ready()

    return count


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 5, least: int = 3, every: int = EVERY) -> DataFrame:
    """``word, n`` of all words of at least ``shortest`` code points that occur at least ``least`` times."""
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(_counter(every, shortest), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


# ---------------------------------------------------------------- groups
def _place(m: F.Column, a: F.Column, b: F.Column, word: F.Column) -> F.Column:
    """A word's place in the group of length ``m`` whose words agree on ``a`` code points at the front and ``b`` at the back."""
    key = F.xxhash64(m, a, b, word.substr(F.lit(1), a), word.substr(F.length(word) - b + 1, b))
    return F.struct(m.cast("int").alias("m"), a.cast("int").alias("a"), b.cast("int").alias("b"), key.alias("key"))


def _halves(m: F.Column, a: F.Column, b: F.Column, word: F.Column) -> F.Column:
    """The two groups that a group's words go to: agreed on half of what is left at the front, or else at the back.

    The pairs of a group have a common prefix of ``a`` to ``m - b - 1``: those of ``a + half`` or more are in the first half.
    """
    left = m - a - b
    half = F.floor(left / 2).cast("int")
    return F.array(_place(m, a + half, b, word), _place(m, a, b + left - half, word))


def groups(words: DataFrame, group: int = GROUP, cells: int = CELLS) -> DataFrame:
    """``word, n, m, a, b, key``: a row for each group that a word is in."""
    longer = words.select("word", "n", F.explode(F.array(F.length("word"), F.length("word") + 1)).alias("m"))
    at = longer.select("word", "n", F.explode(_halves(F.col("m"), F.lit(0), F.lit(0), F.col("word"))).alias("g")).select("word", "n", "g.*")
    done = None
    while True:
        sizes = at.groupBy("m", "a", "b", "key").agg(F.count("*").alias("size")).filter((F.col("m") - F.col("a") - F.col("b") >= 2) & ((F.col("size") > group) | (F.col("size") * F.col("m") > cells)))
        sizes = materialise(sizes.select("m", "a", "b", "key", F.lit(True).alias("large")), "groups")
        n = sizes.count()
        if n == 0:
            return at if done is None else done.unionByName(at)
        marked = at.join(F.broadcast(sizes) if n <= SENT else sizes, ["m", "a", "b", "key"], "left")
        small = marked.filter("large is null").drop("large").select(at.columns)
        done = small if done is None else done.unionByName(small)
        split = marked.filter("large").select("word", "n", F.explode(_halves(*(F.col(c) for c in ("m", "a", "b", "word")))).alias("g")).select("word", "n", "g.*")
        at = materialise(split, "halves")


# ---------------------------------------------------------------- tiles
def _matrices(words: list[bytes], width: int, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of words, by column: from the left, and from the right."""
    shape = (len(words), width)
    left = np.frombuffer(b"".join(w.ljust(width, bytes([pad])) for w in words), np.uint8).reshape(shape)
    right = np.frombuffer(b"".join(w.rjust(width, bytes([pad])) for w in words), np.uint8).reshape(shape)
    return np.ascontiguousarray(left.T), np.ascontiguousarray(right.T[::-1])


def _common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Length of the common beginning of every word of ``x`` with every one of ``y``."""
    same = x[0][:, None] == y[0][None, :]
    reach = same.astype(np.uint8 if len(x) < 256 else np.int32)
    for c in range(1, len(x)):
        same &= x[c][:, None] == y[c][None, :]
        reach += same
    return reach


def compare(x: list[bytes], y: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs of a word of ``x`` and one of ``y`` that are one edit apart, or equal: their indexes and common prefixes."""
    width = max(map(len, (*x, *y)))
    (xl, xr), (yl, yr) = _matrices(x, width, 0), _matrices(y, width, 1)  # pads that match nothing
    prefix = _common(xl, yl)
    sizes = [np.fromiter(map(len, z), np.int32, len(z)) for z in (x, y)]
    longer = np.maximum.outer(*sizes)
    i, j = np.nonzero((prefix.astype(np.int32) + _common(xr, yr) >= longer - 1) & (longer - np.minimum.outer(*sizes) <= 1))
    return i, j, prefix[i, j].astype(np.int64)


def _tiles(bounds: list[tuple[int, int]], m: np.ndarray, tile: int) -> Iterator[tuple[tuple[int, int], tuple[int, int]]]:
    """Pairs of row ranges to compare. Small groups of one length share a tile; a large one is cut into tiles, each compared with itself and those after it."""
    begin = end = None
    for lo, hi in bounds:
        most = max(1, min(tile, CELLS // int(m[lo])))
        if begin is not None and (hi - begin > most or m[begin] != m[lo]):
            yield (begin, end), (begin, end)
            begin = None
        if hi - lo > most:
            parts = list(pairwise([*range(lo, hi, most), hi]))
            yield from ((p, q) for k, p in enumerate(parts) for q in parts[k:])
            continue
        begin, end = lo if begin is None else begin, hi
    if begin is not None:
        yield (begin, end), (begin, end)


def _near(rows: pd.DataFrame, tile: int) -> pd.DataFrame | None:
    """``word, n_near, form, form_n`` of the words of whole groups, which lie together in ``rows``; None if none are near."""
    words = [w.encode("latin-1") for w in rows.word]
    key, m, a, b = (rows[c].to_numpy() for c in ("key", "m", "a", "b"))
    new = np.flatnonzero((key[1:] != key[:-1]) | (m[1:] != m[:-1])) + 1
    number = np.zeros(len(rows), np.int64)
    number[new] = 1
    number = np.cumsum(number)
    size = np.fromiter(map(len, words), np.int64, len(words))
    found = []
    for (p, q), (r, s) in _tiles(list(pairwise([0, *new.tolist(), len(rows)])), m, tile):
        i, j, prefix = compare(words[p:q], words[r:s])
        i, j = i + p, j + r
        ok = (i < j) & (number[i] == number[j]) & (np.maximum(size[i], size[j]) == m[i]) & (prefix >= a[i]) & (prefix < m[i] - b[i])
        found += [(i[ok], j[ok]), (j[ok], i[ok])]
    x, y = (np.concatenate(z) for z in zip(*found, strict=True))
    if len(x) == 0:
        return None
    n = rows.n.to_numpy()
    seen = np.unique(y)
    rank = np.zeros(len(rows), np.int64)
    rank[sorted(seen.tolist(), key=words.__getitem__)] = np.arange(len(seen))
    order = np.lexsort((rank[y], -n[y], x))
    x, y = x[order], y[order]
    at, first, count = np.unique(x, return_index=True, return_counts=True)
    names = rows.word.to_numpy()
    return pd.DataFrame({"word": names[at], "n_near": count, "form": names[y[first]], "form_n": n[y[first]]})


def _tiler(tile: int):
    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for b in batches:
            held = b if held is None else pd.concat([held, b], ignore_index=True)
            last = (held.key == held.key.iloc[-1]) & (held.m == held.m.iloc[-1])
            cut = len(held) - int(last.to_numpy()[::-1].argmin() or len(held))  # the last group may go on in the next batch
            if cut:
                if (found := _near(held.iloc[:cut].reset_index(drop=True), tile)) is not None:
                    yield found
                held = held.iloc[cut:].reset_index(drop=True)
        if held is not None and (found := _near(held, tile)) is not None:
            yield found

    return near


def near_words(words: DataFrame, group: int = GROUP, tile: int = TILE) -> DataFrame:
    """``word, n, n_near, form, form_n`` of all ``words`` (``word, n``): the number of near words, and of those the one of largest n (ties: smallest)."""
    spark = words.sparkSession
    met = groups(words, group).select("word", "n", "m", "a", "b", "key")
    met = met.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "m", "key").sortWithinPartitions("m", "key")
    links = met.mapInPandas(_tiler(tile), "word string, n_near long, form string, form_n long")
    best = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("less"), "form")))
    every = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("string").alias("form"), F.lit(None).cast("long").alias("form_n"))
    both = every.unionByName(links.withColumn("n", F.lit(0).cast("long")))
    return both.groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for ``word, form`` of the words that have a form: the form's form and so on, by doubling."""
    done, at = None, materialise(forms.select("word", F.col("form").alias("root")), "forms")
    links = at
    while True:
        # where a root has a root of its own, the word goes on from that one; such words are fewer each time
        step = at.join(links.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left")
        step = materialise(step.select("word", "root", "next"), "forms")
        ended = step.filter("next is null").select("word", "root")
        done = ended if done is None else done.unionByName(ended)
        at = step.filter("next is not null").select("word", F.col("next").alias("root"))
        if at.isEmpty():
            return done
        links = materialise(at.unionByName(done), "forms")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 5, least: int = 3, ratio: int = 2, every: int = EVERY, group: int = GROUP, tile: int = TILE) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of the corpus.

    Words are runs of the letters A-Z, a-z and U+00C0 to U+00FF in lower case (A-Z only), of which a few lose a code
    point by a hash of id and run (``every``), as in the contract of ``op11``. Null and empty texts have no words;
    a null id counts as an empty one; rows with repeated ids count each. A word's form is its near word of largest n
    (ties: the smallest in code-point order) if that n is at least ``ratio`` (2 or more: so forms end) times its own,
    else null. Runs of any length are words. An empty table gives an empty result. Other columns of ``docs`` are not used.
    """
    if ratio < 2:
        raise ValueError("a ratio below 2 lets forms go in circles")
    words = materialise(count_words(docs, id_col, text_col, shortest, least, every), "words")
    near = near_words(words, group, tile)
    has = F.col("form_n") >= ratio * F.col("n")
    near = materialise(near.select("word", "n", "n_near", F.when(has, F.col("form")).alias("form"), F.when(has, F.col("form_n")).alias("form_n")), "near")
    roots = _roots(near.filter("form is not null"))
    return near.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: spelling variants of the words of all documents."""
    return spelling_variants(read_table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH RECURSIVE seen AS MATERIALIZED (
  SELECT s, run, count(*) AS n FROM (
    SELECT doc_id::VARCHAR || ':' || run AS s, run FROM (
      SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents) q) r
  GROUP BY s, run),
{crc_tables("SELECT max(strlen(s)) FROM seen")},
crcs AS MATERIALIZED ({crc_of("seen")}),
words AS MATERIALIZED (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN crc % 97 = 0 THEN left(run, crc % length(run)) || substr(run, crc % length(run) + 2) ELSE run END AS word, n FROM seen JOIN crcs USING (s)) q
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cuts AS MATERIALIZED (SELECT word, n, i, left(word, i) AS a, substr(word, i + 2) AS b FROM words, unnest(range(length(word))) AS u(i)),
shorter AS (SELECT DISTINCT c.word, c.n, w.word AS other, w.n AS other_n FROM cuts c JOIN words w ON w.word = a || b),
near AS MATERIALIZED (
  SELECT x.word, y.word AS other, y.n AS other_n FROM cuts x JOIN cuts y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION ALL SELECT word, other, other_n FROM shorter UNION ALL SELECT other, word, n FROM shorter),
best AS (SELECT word, count(*) AS n_near, max(other_n) AS most, arg_min(other, (-other_n, other)) AS other FROM near GROUP BY word),
forms AS MATERIALIZED (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 2 * n THEN other END AS form, CASE WHEN most >= 2 * n THEN most END AS form_n FROM words LEFT JOIN best USING (word)),
walk(word, node, step) AS (
  SELECT word, word, 0 FROM forms
  UNION ALL SELECT w.word, f.form, w.step + 1 FROM walk w JOIN forms f ON f.word = w.node WHERE f.form IS NOT NULL)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM forms f JOIN (SELECT word, max_by(node, step) AS root FROM walk GROUP BY word) r USING (word)
"""

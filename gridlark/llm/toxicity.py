"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words, pairs of neighbours and pairs with one word between are hashed to coordinates; a coordinate counts once a text.
A bounded, hash-ordered sample of labelled rows is hashed once and dealt to parts by hashes of ids; the parts run
FTRL-proximal side by side: a learning rate for each coordinate, and L1 that keeps most weights at zero. After every
pass the parts' whole states are averaged slice by slice, and the next pass starts from the average. The weights left
are few; their number has a bound, and they go to all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, read_table, release_memory

#: Coordinates (2 ** BITS bounds the weights), labelled ids to learn from at most, passes.
BITS, LABELLED, PASSES = 19, 24_000, 5
#: Parts at least, coordinates that a part holds on average at most, coordinates in a slice of a state.
PARTS, PART, STATE = 6, 8_000_000, 65_536
ALPHA, BETA, L1, L2 = 3.0, 1.0, 2.0, 0.1
THRESHOLD = 0.7
#: Words hashed at a time, which bounds what a very long text takes; words whose hashes a worker remembers.
SLICE, REMEMBERED = 100_000, 150_000

# Odd multipliers that mix word hashes into coordinates.
_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD))
_SPACES = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) >= REMEMBERED:
            self.clear()
        h = self[word] = xxh64_intdigest(word, seed=7)
        return h


_hashes = _WordHashes()


def coordinates(text: str | None, bits: int = BITS) -> np.ndarray:
    """Sorted distinct coordinates of a text's words, pairs and pairs with a gap of one word."""
    words = (text or "").lower().encode("utf-8", "surrogatepass").translate(_SPACES).split()
    shift, parts = np.uint64(64 - bits), []
    for i in range(0, len(words), SLICE):
        part = words[i : i + SLICE + 2]
        h = np.fromiter(map(_hashes.__getitem__, part), np.uint64, len(part))
        parts += [h * _MIX[0] >> shift, (h[:-1] * _MIX[1] + h[1:] * _MIX[2]) * _MIX[0] >> shift, (h[:-2] * _MIX[3] + h[2:] * _MIX[4]) * _MIX[0] >> shift]
    return np.unique(np.concatenate(parts)).astype(np.int64) if parts else np.zeros(0, np.int64)


def _sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -35, 35))))


class Ftrl:
    """FTRL-proximal state; coordinate 2 ** bits is the intercept, which has no L1."""

    def __init__(self, bits: int = BITS):
        self.bits, self.z, self.n = bits, np.zeros(2**bits + 1), np.zeros(2**bits + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == len(self.z) - 1, 0.0, L1)
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, label: int) -> None:
        at = np.append(at, len(self.z) - 1)
        w = self.weights(at)
        g = _sigmoid(w.sum()) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def pack_coordinates(at: np.ndarray, bits: int) -> bytes:
    """Ascending coordinates in two bytes each: how many there are for every value of the higher bits, and the lower 16 bits."""
    return np.bincount(at >> 16, minlength=2 ** max(0, bits - 16)).astype("<u4").tobytes() + (at & 0xFFFF).astype("<u2").tobytes()


def unpack_coordinates(packed: bytes, bits: int) -> np.ndarray:
    high = 2 ** max(0, bits - 16)
    counts = np.frombuffer(packed, "<u4", high)
    return (np.repeat(np.arange(high), counts) << 16) | np.frombuffer(packed, "<u2", offset=4 * high)


def labelled_rows(docs: DataFrame, labels: DataFrame, limit: int = LABELLED) -> DataFrame:
    """``id, toxic, text`` of at most ``limit`` labelled ids that may be learnt from, those of least hash, one row each.

    A row may be learnt from if crc32 of its id as text, modulo 3, is not 1. An id with several labels is toxic if
    one of them says so, an id with several texts gives the least of them; null ids and labels are left out.
    """
    known = labels.filter("doc_id is not null and toxic is not null and crc32(cast(cast(doc_id as string) as binary)) % 3 <> 1")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    known = materialise(known.select(F.col("doc_id").alias("id"), "toxic"), "tox-labels")
    rows = docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(known), "id")  # at most `limit` rows of two columns
    return rows.groupBy("id").agg(F.max("toxic").cast("int").alias("toxic"), F.min("text").alias("text"))


def learn_part(state: Ftrl, packed: list, toxic: np.ndarray, turn: int, part: int) -> None:
    """One pass over a part's rows, in an order that pass and part determine."""
    for k in np.random.default_rng([turn, part]).permutation(len(packed)):
        state.learn(unpack_coordinates(packed[k], state.bits), int(toxic[k] > 0))


def _mean(slices: pd.Series) -> bytes:
    """Mean of single-precision slices, summed in double precision and in order."""
    return np.mean([np.frombuffer(x, "<f4") for x in slices], axis=0, dtype=float).astype("<f4").tobytes()


def _read_state(rows: pd.DataFrame, bits: int) -> tuple[np.ndarray, np.ndarray]:
    z, n = np.zeros(2**bits + 1), np.zeros(2**bits + 1)
    for r in rows.itertuples():
        z[r.slice * STATE : (r.slice + 1) * STATE], n[r.slice * STATE : (r.slice + 1) * STATE] = np.frombuffer(r.z, "<f4"), np.frombuffer(r.n, "<f4")
    return z, n


def fit(docs: DataFrame, labels: DataFrame, limit: int = LABELLED, passes: int = PASSES, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates and weights that are not zero; the last coordinate is the intercept (always there).

    Parts follow from hashes of ids and from the rows' number of coordinates, the order in a part from hashes, pass
    and part, and states are averaged in the order of the parts: the result doesn't depend on partitions, cores or
    batches. Nothing of a state is left out between passes. Without labelled rows the result is the intercept alone,
    at 0: every score is 0.5. Null texts count as empty.
    """

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"key": b.key, "turn": b.turn, "toxic": b.toxic, "at": [pack_coordinates(coordinates(t, bits), bits) for t in b.text]})
        _hashes.clear()
        release_memory()

    rows = labelled_rows(docs, labels, limit).select(F.xxhash64("id").alias("key"), F.xxhash64("id", F.lit(2)).alias("turn"), "toxic", "text")
    rows = materialise(rows.mapInPandas(hashed, "key long, turn long, toxic int, at binary"), "tox-rows")
    parts = max(PARTS, -(-(rows.agg(F.coalesce(F.sum(F.length("at")), F.lit(0))).first()[0] // 2) // PART))

    def pack(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["turn", "key"])
        return pd.DataFrame({"part": b.part.iloc[:1], "toxic": [b.toxic.to_numpy("<i4").tobytes()], "sizes": [b["at"].map(len).to_numpy("<i8").tobytes()], "at": [b"".join(b["at"])]})

    dealt = rows.withColumn("part", F.pmod("key", F.lit(parts)).cast("int")).repartitionByRange(parts, "part")
    dealt = materialise(dealt.groupBy("part").applyInPandas(pack, "part int, toxic binary, sizes binary, at binary"), "tox-parts")

    def mean(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("part")
        return pd.DataFrame({"slice": b.slice.iloc[:1], "z": [_mean(b.z)], "n": [_mean(b.n)]})

    z, n = np.zeros(2**bits + 1), np.zeros(2**bits + 1)
    for p in range(passes):
        sent = rows.sparkSession.sparkContext.broadcast((z, n))  # 2 ** bits coordinates

        def learn(batches: Iterator[pd.DataFrame], sent=sent, p=p) -> Iterator[pd.DataFrame]:
            for part in (r for b in batches for r in b.itertuples()):
                state = Ftrl(bits)
                state.z[:], state.n[:] = sent.value
                ends, at = np.cumsum(np.frombuffer(part.sizes, "<i8")).tolist(), memoryview(part.at)
                learn_part(state, [at[i:j] for i, j in zip([0, *ends], ends, strict=False)], np.frombuffer(part.toxic, "<i4"), p, part.part)
                cuts = range(0, 2**bits + 1, STATE)
                yield pd.DataFrame({"slice": range(len(cuts)), "part": part.part, "z": [state.z[i : i + STATE].astype("<f4").tobytes() for i in cuts], "n": [state.n[i : i + STATE].astype("<f4").tobytes() for i in cuts]})
            release_memory()

        states = dealt.mapInPandas(learn, "slice int, part int, z binary, n binary").groupBy("slice").applyInPandas(mean, "slice int, z binary, n binary")
        z, n = _read_state(states.toPandas(), bits)
        sent.unpersist()
    state = Ftrl(bits)
    state.z, state.n = z, n
    w = state.weights(np.arange(2**bits + 1))
    at = np.union1d(np.flatnonzero(w), [2**bits])
    return at, w[at]


def score_column(spark: SparkSession, model: tuple[np.ndarray, np.ndarray], text: F.Column) -> F.Column:
    """Score of a text in [0, 1] (null: empty)."""
    sent = spark.sparkContext.broadcast(model)  # at most 2 ** BITS weights

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        at, weights = sent.value
        dense = np.zeros(at[-1] + 1)  # the intercept is the last coordinate
        dense[at] = weights
        bits = int(at[-1]).bit_length() - 1
        for texts in batches:
            yield pd.Series([_sigmoid(dense[-1] + dense[coordinates(t, bits)].sum()) for t in texts], dtype=float)
        _hashes.clear()
        release_memory()

    return score(text)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``.

    Only the text enters a score: equal texts have equal scores, null and empty texts the intercept's. ``held_out``
    is null for a null id. Repeated rows come back as they are; other columns are not carried.
    """
    model = fit(docs, labels)
    held = F.expr("crc32(cast(cast(doc_id as string) as binary)) % 3 = 1")
    scored = docs.select("doc_id", held.alias("held_out"), score_column(docs.sparkSession, model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows whose score reaches the threshold; columns, whatever their names, stay as they are.

    Null and empty texts score like any other, repeated rows and equal texts alike; an empty table gives an empty
    result.
    """
    model = fit(docs, labels)
    return docs.filter(score_column(docs.sparkSession, model, F.col("text")) < THRESHOLD)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: toxicity score of every document."""
    return score_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))

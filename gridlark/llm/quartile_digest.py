"""Document fingerprints: quartile bucket digests of byte triplets, and their bounded difference score.

Every three neighbouring bytes of a text (with two zero bytes at either end) are hashed to a bucket. A bucket's code
is the quartile, 0 to 3, in which its count lies among all buckets' counts. The digest is the length's logarithm in
two hexadecimal digits and the codes in two bits each. The difference of two digests adds the codes' differences and
the lengths'; it is bounded by construction, and likeness is one less its share of the bound.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

#: log2 of the number of buckets; bytes hashed at a time; the share of the lengths in a difference.
BITS, SLICE, LENGTH_SHARE = 10, 1 << 20, 0.02


def _length_code(n: int) -> int:
    """Logarithm of the length to the base 1.1, in a byte."""
    return min(255, round(math.log(n + 1, 1.1)))


def codes(text: str, bits: int = BITS) -> tuple[int, np.ndarray]:
    """Length code and quartile codes of a text."""
    raw = text.encode("utf-8", "surrogatepass")
    b = np.frombuffer(b"\0\0" + raw + b"\0\0", np.uint8)
    count = np.zeros(2**bits, np.int64)
    for i in range(0, len(b) - 2, SLICE):  # bounded memory for very long texts
        x = b[i : i + SLICE + 2].astype(np.uint32)
        triple = x[:-2] | x[1:-1] << np.uint32(8) | x[2:] << np.uint32(16)
        count += np.bincount(triple * np.uint32(0x9E3779B1) >> np.uint32(32 - bits), minlength=2**bits)
    n = len(count)
    q = np.partition(count, (n // 4 - 1, n // 2 - 1, 3 * n // 4 - 1))[[n // 4 - 1, n // 2 - 1, 3 * n // 4 - 1]]
    return _length_code(len(raw)), np.searchsorted(q, count, side="left").astype(np.int8)


def digest(code: tuple[int, np.ndarray]) -> str:
    four = code[1].reshape(-1, 4).astype(np.uint8)
    return f"{code[0]:02x}" + (four[:, 0] << 6 | four[:, 1] << 4 | four[:, 2] << 2 | four[:, 3]).tobytes().hex()


def undigest(text: str) -> tuple[int, np.ndarray]:
    b = np.frombuffer(bytes.fromhex(text[2:]), np.uint8)
    return int(text[:2], 16), np.stack([b >> 6, b >> 4 & 3, b >> 2 & 3, b & 3], axis=1).ravel().astype(np.int8)


def likeness(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> float:
    """1 for equal digests, down to 0."""
    buckets = float(np.abs(a[1] - b[1]).mean()) / 3
    return 1 - (1 - LENGTH_SHARE) * buckets - LENGTH_SHARE * min(1.0, abs(a[0] - b[0]) / 64)


def edit(text: str, other: str) -> str:
    """The last half of the code points, rounded down, replaced by as many of the other's first ones, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def with_successors(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``bucket, last, id, text, real``: rows in buckets of ascending id, each bucket followed by the first row of the next.

    Order is by id, nulls first, then by the text's hash. Buckets are ranges of ids cut at approximate percentiles;
    only their bounds (a few for each shuffle partition) come to the driver. The rows with the least id of a bucket
    go to the bucket before as well, and those with the least id of all to the last one, so that every row finds its
    successor beside it after one shuffle.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = 4 * parts
    ids = docs.select(F.col(id_col).cast("long").alias("id"))
    cuts = ids.agg(F.percentile_approx("id", [i / n for i in range(1, n)], max(10_000, 10 * n)).alias("c")).first().c
    bounds = np.unique(np.array(cuts or [], np.int64))

    def bucket_of(values: pd.Series) -> pd.Series:
        known = values.notna()
        out = np.zeros(len(values), np.int32)
        out[known] = np.searchsorted(bounds, values[known].to_numpy(np.int64), side="right") + 1
        return pd.Series(out)

    bucket = F.pandas_udf(bucket_of, "int")
    # what each bucket begins with: one row for each bucket
    heads = ids.withColumn("bucket", bucket("id")).groupBy("bucket").agg(F.min("id").alias("id")).orderBy("bucket").collect()
    to_previous = {h.id: heads[k - 1].bucket for k, h in enumerate(heads) if k}
    last = heads[-1].bucket if heads else 0
    first = heads[0].id if heads else None

    def targets(values: pd.Series) -> pd.Series:
        """``bucket * 4 + kind``: 0 a row of its own, 1 the next bucket's first row, 2 the first row of all."""
        own = bucket_of(values).tolist()
        keys = [None if pd.isna(v) else int(v) for v in values]
        out = []
        for v, b in zip(keys, own, strict=True):
            t = [4 * b]
            if v in to_previous:
                t.append(4 * to_previous[v] + 1)
            if v == first:
                t.append(4 * last + 2)
            out.append(t)
        return pd.Series(out, dtype=object)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("t", F.explode(F.pandas_udf(targets, "array<long>")("id")))
    rows = rows.select((F.col("t") / 4).cast("int").alias("bucket"), F.pmod("t", F.lit(4)).cast("int").alias("kind"), "id", "text")
    # the bucket's own rows come before the row that follows them
    return rows.repartition(parts, "bucket").sortWithinPartitions("bucket", "kind", F.asc_nulls_first("id"), F.xxhash64("text"))


SCHEMA = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held = None  # the row that waits for its successor: bucket, id, text, codes
    for b in batches:
        out = []
        for bucket, kind, id_, text in zip(b.bucket, b.kind, b.id, b.text, strict=True):
            code = codes(text) if kind == 0 or (held and held[0] == bucket) else None
            if held and held[0] == bucket:
                edited = edit(held[2], text)
                edited_code = codes(edited)
                sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                out.append((held[1], len(held[2]), sha, digest(held[3]), digest(edited_code), likeness(held[3], edited_code), likeness(held[3], code)))
                held = None
            if kind == 0:
                held = (bucket, None if pd.isna(id_) else int(id_), text, code)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")]).astype({"id": "Int64"})


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digest of every text and of its edit: ``<id_col>, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.

    A text is edited with the next document's, by ascending id; after the last comes the first, so a single row
    follows itself. Null texts count as empty. Rows without an id come first; rows with equal ids are ordered by
    their texts' hashes. An empty table gives an empty result. Other columns are not carried.
    """
    rows = with_successors(docs, id_col, text_col).mapInPandas(_compare, SCHEMA)
    return rows.withColumnRenamed("id", id_col)


def fingerprint_column(text: F.Column) -> F.Column:
    """Digest of a text (null: empty)."""

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([digest(codes(t or "")) for t in texts], dtype=object)

    return of(text)


def likeness_column(a: F.Column, b: F.Column) -> F.Column:
    """Likeness of two digests (null if either is)."""

    @F.pandas_udf("double")
    def of(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else likeness(undigest(p), undigest(q)) for p, q in zip(x, y, strict=True)], dtype=float)

    return of(a, b)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: fingerprints of every document and of its edit."""
    return fingerprint_documents(read_table(spark, sf_dir, "documents"))

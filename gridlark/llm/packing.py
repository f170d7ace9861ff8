"""Token ids in packed rows: best-fit-decreasing packing with a segment tree over free capacity.

Documents are tokenised where they are read and packed window by window, without a shuffle. A text of more than a
row's tokens is split: its full pieces become rows of their own at once, so a window holds a bounded number of
tokens however long a text is. Other pieces are placed longest first, each in the open row with the least free room
that takes it; a segment tree with the number of open rows for each amount of room finds it.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Ids in a row, the id that fills it up (free in the vocabulary), and the tokens and pieces that close a window.
ROW, PAD, WINDOW, PIECES = 2048, 50_256, 2_000_000, 20_000
#: ``doc_ids`` travel as strings and get their type back outside Python, so that nulls don't make floats of them.
SCHEMA = "pack_id long, n_tokens int, ids binary, cu_seqlens array<int>, position_resets array<int>, doc_keys array<long>, doc_ids array<string>, parts array<int>, part_counts array<int>"


class RoomTree:
    """Open rows by free room: ``take(need)`` gives a row with the least room of at least ``need``, or None."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def _change(self, room: int, by: int) -> None:
        i = room + self.leaves
        while i:
            self.count[i] += by
            i >>= 1

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._change(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        i = need + self.leaves
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):  # up, until there is something to the right
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:  # down, to the left where that is possible
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        room = i - self.leaves
        self._change(room, -1)
        return room, self.rows[room].pop()


def best_fit_decreasing(sizes: list[int], row: int) -> list[list[int]]:
    """Indexes of ``sizes`` (0 to ``row`` each) by row; longest first, ties in order."""
    tree, rows = RoomTree(row), []
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        found = tree.take(sizes[k])
        if found is None:
            found = (row, len(rows))
            rows.append([])
        room, at = found
        rows[at].append(k)
        tree.put(room - sizes[k], at)
    return rows


@lru_cache(maxsize=4)
def encoder(path: str):
    """One encoder for each vocabulary and Python worker; strings of special tokens are ordinary text."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _packer(path: str, row: int, pad: int, dtype: str):
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        context = TaskContext.get()
        first = context.partitionId() << 40
        encode, made, read = encoder(path).encode_ordinary, 0, 0
        pieces: list[tuple[int, str | None, int, int, np.ndarray]] = []  # key, id, part, parts, ids
        out: list[tuple] = []

        def emit(members: list[tuple[int, str | None, int, int, np.ndarray]]) -> None:
            nonlocal made
            matrix = np.full(row, pad, dtype)
            ends = np.cumsum([0] + [len(m[4]) for m in members])
            matrix[: ends[-1]] = np.concatenate([m[4] for m in members])
            ends = ends.tolist()
            out.append((first + made, ends[-1], matrix.tobytes(), ends, ends[:-1], *([m[i] for m in members] for i in range(4))))
            made += 1

        def close() -> None:
            for members in best_fit_decreasing([len(p[4]) for p in pieces], row):
                emit([pieces[k] for k in members])
            pieces.clear()

        def ready() -> pd.DataFrame:
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])
            out.clear()
            return frame

        held = 0
        for b in batches:
            for id_, text in zip(b.id, b.text, strict=True):
                ids = np.array(encode(text or ""), dtype)
                key, read = first + read, read + 1
                parts = max(1, -(-len(ids) // row))
                for k in range(parts):
                    piece = (key, id_, k, parts, ids[k * row : (k + 1) * row])
                    if len(piece[4]) == row:
                        emit([piece])
                    else:
                        pieces.append(piece)
                        held += len(piece[4])
                if held >= WINDOW or len(pieces) >= PIECES:
                    close()
                    held = 0
                if len(out) >= 500:
                    yield ready()
        close()
        yield ready()

    return pack


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row: int = ROW, path: str | None = None, pad: int = PAD, dtype: str = "<u2") -> DataFrame:
    """Packed rows of all texts, see ``SCHEMA``.

    ``ids``: ``row`` token ids, little-endian, filled up with ``pad``. ``cu_seqlens``: where segments begin, and the
    row's end; ``position_resets``: where positions count from 0 again. ``doc_keys, doc_ids, parts, part_counts``: of
    each segment its document, and which of how many pieces of it. A key is a row of ``docs``: rows with null or
    repeated ids, of whatever type, are packed like others and can be told apart. Null and empty texts are segments of
    no tokens. An empty table gives an empty result. ``pack_id`` and keys are unique and follow the input's partitions.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    packs = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).mapInPandas(_packer(path, row, pad, dtype), SCHEMA)
    return packs.withColumn("doc_ids", F.col("doc_ids").cast(f"array<{docs.schema[id_col].dataType.simpleString()}>"))


def write_packs(packs: DataFrame, path: str) -> None:
    """The packed matrices as Parquet files: a file's ``ids`` are rows of equal length, beside their segment lengths and resets."""
    packs.write.option("compression", "zstd").parquet(path)


def segments(packs: DataFrame, dtype: str = "<u2") -> DataFrame:
    """``pack_id, doc_key, doc_id, part, part_count, ids array<int>`` of every segment."""
    kind = packs.schema["doc_ids"].dataType.elementType.simpleString()

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for p in b.itertuples(index=False):
                ids, cuts = np.frombuffer(p.ids, dtype), list(p.cu_seqlens)
                out += [(p.pack_id, key, d, k, n, ids[x:y].astype(np.int32)) for key, d, k, n, x, y in zip(p.doc_keys, p.doc_ids, p.parts, p.part_counts, cuts, cuts[1:], strict=False)]
            yield pd.DataFrame(out, columns=["pack_id", "doc_key", "doc_id", "part", "part_count", "ids"])

    cut = packs.withColumn("doc_ids", F.col("doc_ids").cast("array<string>")).mapInPandas(split, "pack_id long, doc_key long, doc_id string, part int, part_count int, ids array<int>")
    return cut.withColumn("doc_id", F.col("doc_id").cast(kind))


def unpack(packs: DataFrame, dtype: str = "<u2") -> DataFrame:
    """``doc_key, doc_id, ids array<int>`` of every document: its pieces joined in order."""
    pieces = F.array_sort(F.collect_list(F.struct("part", "ids")))
    return segments(packs, dtype).groupBy("doc_key").agg(F.first("doc_id").alias("doc_id"), F.flatten(F.transform(pieces, lambda p: p["ids"])).alias("ids"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: all documents in packed rows."""
    return pack_documents(read_table(spark, sf_dir, "documents"))

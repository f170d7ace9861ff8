"""Packed training sequences: first-fit decreasing with a tournament tree of bin capacities, in randomised groups.

Documents are tokenised where they are read. Whole sequences of a long text stand for themselves; what is left of each
document (less than a sequence) is dealt at random into groups of bounded size, which are packed independently. In a
group, pieces are placed longest first into the first sequence with room enough; the tournament tree holds the largest
room of every range of sequences, so that the first one is found on one way down. Afterwards the emptiest sequences
are dissolved into the rooms that are left: documents may be cut anywhere, and a room takes one cut at most. What the
last sequence holds is cut at powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, read_table
from .packing import VOCABULARY as RANKS
from .packing import encoder

VOCABULARY, END = "byte_bpe_50k.json", 0
#: Ids of a sequence, pieces of a group, room that is left as padding rather than cut a document for it.
ROW, GROUP, SLACK = 1024, 2_048, 4
#: Texts of these code points only (Latin letters and common punctuation, no controls that engines class differently)
#: are encoded with the ranks of the same vocabulary, which gives the library's ids in a third of its time.
_ODD = r"[^\t\n\r\x20-\x7e¡-¬®-ɏ‐-‧‰-›€]|<\|endoftext\|>"
TOKENS = "doc_key long, doc_id string, start long, length long, doc_tokens long, sequence_id long, ids binary"
PIECES = "doc_key long, doc_id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


# ---------------------------------------------------------------- ids
@lru_cache(maxsize=4)
def _library(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@lru_cache(maxsize=1)
def _odd():
    import re

    return re.compile(_ODD)


def token_ids(text: str, path: str, ranks: str | None) -> list[int]:
    """The library's ids of a text, without added tokens; strings of special tokens inside it as the library has them."""
    if ranks is None or _odd().search(text):
        return _library(path).encode(text, add_special_tokens=False).ids
    return encoder(ranks).encode_ordinary(text)


def _tokeniser(path: str, ranks: str | None, row: int, end: int, dtype: str):
    def tokenise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 40
        read = made = 0
        names = [c.split()[0] for c in TOKENS.split(", ")]
        for b in batches:
            out = []
            for id_, text in zip(b.id, b.text, strict=True):
                ids = np.array([*token_ids(text or "", path, ranks), end], dtype)
                for at in range(0, len(ids), row):
                    part = ids[at : at + row]
                    whole = len(part) == row
                    # odd numbers: whole sequences of one document; even ones: those of groups
                    out.append((first + read, id_, at, len(part), len(ids), 2 * (first + made) + 1 if whole else None, part.tobytes()))
                    made += whole
                read += 1
            if out:
                frame = pd.DataFrame(out, columns=names)
                frame["sequence_id"] = frame["sequence_id"].astype("Int64")
                yield frame

    return tokenise


# ---------------------------------------------------------------- packing
class Tournament:
    """Rooms of bins in a row; every inner node holds the larger of its two: the way down leads to the first bin with room enough."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.room = [capacity] * (2 * self.leaves)

    def place(self, need: int) -> int:
        room, i = self.room, 1
        if room[1] < need:
            raise ValueError("no bin has room")
        while i < self.leaves:
            i *= 2
            if room[i] < need:
                i += 1
        bin_ = i - self.leaves
        room[i] -= need
        while i > 1:
            i //= 2
            most = max(room[2 * i], room[2 * i + 1])
            if room[i] == most:
                break
            room[i] = most
        return bin_


def first_fit_decreasing(sizes: list[int], row: int) -> list[list[int]]:
    """Indexes of ``sizes`` (1 to ``row`` each) by sequence; longest first, ties in order."""
    tree = Tournament(len(sizes), row)
    bins: list[list[int]] = []
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        at = tree.place(sizes[k])
        if at == len(bins):
            bins.append([])
        bins[at].append(k)
    return bins


def padding(total: int, row: int) -> int:
    """Ids that fill up a sequence of ``total``: none at a power of two."""
    return 0 if total & (total - 1) == 0 else row - total


def cut_and_fill(bins: list[list[int]], sizes: list[int], row: int, slack: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of ``(index, from, length)``: the emptiest are dissolved into the rooms of over ``slack`` of the others, and the last is cut at powers of two."""
    parts = [[(k, 0, sizes[k]) for k in b] for b in bins]
    used = [sum(sizes[k] for k in b) for b in bins]
    order = sorted(range(len(bins)), key=lambda i: (-used[i], i))
    lo, hi = 0, len(order) - 1
    while lo < hi:
        to, source = order[lo], order[hi]
        if padding(used[to], row) <= slack:
            lo += 1
            continue
        k, at, n = parts[source].pop()
        take = min(row - used[to], n)
        parts[to].append((k, at, take))
        used[to] += take
        used[source] -= take
        if take < n:
            parts[source].append((k, at + take, n - take))
        if not parts[source]:
            hi -= 1
    out = [parts[i] for i in order[: hi + 1]]
    if out and padding(sum(n for _, _, n in out[-1]), row) > slack:
        out += _powers(out.pop())
    return out


def _powers(parts: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """The parts as sequences whose lengths are falling powers of two."""
    out, rest = [], sum(n for _, _, n in parts)
    todo = parts[::-1]
    while rest:
        room = 1 << (rest.bit_length() - 1)
        rest -= room
        out.append([])
        while room:
            k, at, n = todo.pop()
            take = min(room, n)
            out[-1].append((k, at, take))
            room -= take
            if take < n:
                todo.append((k, at + take, n - take))
    return out


def _packer(row: int, slack: int, dtype: str, with_ids: bool):
    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_key", "start"], ignore_index=True)
        first = int(rows["group"].iloc[0]) << 21
        sizes = rows["length"].tolist()
        out = []
        key, id_, start, total, ids = (rows[c].tolist() for c in ("doc_key", "doc_id", "start", "doc_tokens", "ids"))
        for s, parts in enumerate(cut_and_fill(first_fit_decreasing(sizes, row), sizes, row, slack)):
            offset = 0
            for k, at, n in parts:
                own = np.frombuffer(ids[k], dtype)[at : at + n]
                out.append((key[k], id_[k], start[k] + at, n, zlib.crc32(own.astype("<u4").tobytes()), total[k], 2 * (first + s), offset, own.tobytes() if with_ids else None))
                offset += n
        return pd.DataFrame(out, columns=[c.split()[0] for c in PIECES.split(", ")])

    return pack


def pack_first_fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row: int = ROW, path: str | None = None, ranks: str | None = None, end: int = END, group: int = GROUP, slack: int = SLACK, dtype: str = "<u2", with_ids: bool = True) -> DataFrame:
    """A row for each piece of each document, see ``PIECES``; ``doc_id`` keeps its type.

    A document is its tokens and the id ``end``; ``start`` counts its ids before the piece, ``offset`` those before it
    in its sequence. ``ids``: those of the piece, little-endian (null unless ``with_ids``); ``ids_crc32``: of them as
    unsigned 32-bit numbers. ``doc_key`` is a row of ``docs``: null or repeated ids are packed like others and can be
    told apart. Null and empty texts are one id, ``end``. Texts of any length are split into whole sequences and a
    rest. An empty table gives an empty result. Other columns are not carried. ``path``, ``ranks``: vocabulary file of
    the library, and the same vocabulary as ranks (None: the library encodes all). ``row`` must be a power of two.
    The table of tokens is written to the shared folder, so that groups survive lost executors.
    """
    if path is None:
        import public_tokenizers

        path, ranks = public_tokenizers.path(VOCABULARY), public_tokenizers.path(RANKS)
    if row < 1 or row & (row - 1):
        raise ValueError("row must be a power of two")
    kind = docs.schema[id_col].dataType
    tokens = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).mapInPandas(_tokeniser(path, ranks, row, end, dtype), TOKENS)
    tokens = materialise(tokens, "tokens")
    rests = tokens.filter("sequence_id is null")
    groups = max(1, -(-rests.count() // group))
    dealt = rests.withColumn("group", F.pmod(F.xxhash64("doc_key", "start"), F.lit(groups)))
    packed = dealt.groupBy("group").applyInPandas(_packer(row, slack, dtype, with_ids), PIECES)

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["ids_crc32"] = [zlib.crc32(np.frombuffer(x, dtype).astype("<u4").tobytes()) for x in b["ids"]]
            b["offset"] = 0
            b["ids"] = b["ids"] if with_ids else None
            yield b[[c.split()[0] for c in PIECES.split(", ")]]

    alone = tokens.filter("sequence_id is not null").mapInPandas(whole, PIECES)
    return packed.unionByName(alone).withColumn("doc_id", F.col("doc_id").cast(kind))


# ---------------------------------------------------------------- sequences and back
def sequences(pieces: DataFrame, row: int = ROW, pad: int = 50_256, dtype: str = "<u2") -> DataFrame:
    """``sequence_id, n_tokens, ids, cu_seqlens, doc_keys, starts`` of every sequence: its ids padded to ``row`` (not at a power of two), where its pieces begin and end, and what they are."""

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for s, parts in zip(b.sequence_id, b.parts, strict=True):
                ends = np.cumsum([0] + [p["length"] for p in parts]).tolist()
                ids = b"".join(p["ids"] for p in parts) + np.full(padding(ends[-1], row), pad, dtype).tobytes()
                out.append((s, ends[-1], ids, ends, [p["doc_key"] for p in parts], [p["start"] for p in parts]))
            if out:
                yield pd.DataFrame(out, columns=["sequence_id", "n_tokens", "ids", "cu_seqlens", "doc_keys", "starts"])

    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "doc_key", "start", "ids"))).alias("parts")
    return pieces.groupBy("sequence_id").agg(parts).mapInPandas(fill, "sequence_id long, n_tokens long, ids binary, cu_seqlens array<long>, doc_keys array<long>, starts array<long>")


def write_sequences(packed: DataFrame, path: str) -> None:
    """The id matrices as Parquet files, beside their segment lengths."""
    packed.write.option("compression", "zstd").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: all documents in sequences of at most 1,024 ids."""
    return pack_first_fit(read_table(spark, sf_dir, "documents"), with_ids=False).drop("doc_key", "ids")

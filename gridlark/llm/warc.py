"""WARC archives as a chunked record table.

Payloads are cut into chunks by Spark, and only chunks reach Python: a chunk becomes a record segment (the first a
``response``, the others ``continuation`` records) whose headers carry the record's identifier, its number and the
digest of the payload so far. Segments are written with Spark's text writer as plain WARC/1.1 files, and read with
the version line as record delimiter, so files split at any size. A segment never holds the delimiter: a payload that
does is cut inside it. Reading gives a table of ``record, chunk, payload`` rows; digests of a record with many chunks
are taken chunk by chunk in one sorted stream.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, read_table, scratch_path

#: Bytes of a chunk, least payload that is deduplicated, date of the records.
CHUNK, LEAST, DATE = 1 << 18, 0, "2024-01-01T00:00:00Z"
_VERSION = b"WARC/1.1\r\n"
_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:gridlark:warc")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record_id(page_id: int | None, sha1_hex: str) -> str:
    """Identifier of a page's record; rows with equal id and payload share it."""
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}/{sha1_hex}')}>"


def _header(fields: list[tuple[str, object]]) -> bytes:
    lines = (f"{k}: {str(v).replace(chr(13), '%0D').replace(chr(10), '%0A').replace('WARC/1.1', 'WARC/1%2E1')}\r\n" for k, v in fields if v is not None)
    return "".join(lines).encode("utf-8", "surrogatepass") + b"\r\n"


def chunk_rows(pages: DataFrame, least: int = LEAST, chunk: int = CHUNK) -> DataFrame:
    """``page_id, url, sha1, size, refers, number, chunks, chunk``: payloads in pieces, in order; revisits have one empty piece.

    The table of payloads that occur more than once is written first: where Spark then sees that it is small, pages
    join it without a shuffle, and a large one is joined by a shuffle that splits hot payloads.
    """
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("body"))
    rows = rows.select("page_id", "url", "body", F.sha1("body").alias("sha1"), F.octet_length("body").cast("long").alias("size"))
    groups = rows.filter(F.col("size") >= least).groupBy("sha1").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n"))
    repeated = materialise(groups.filter("n > 1 and keeper is not null").select("sha1", "keeper"), "warc-repeated")
    rows = rows.join(repeated, "sha1", "left").withColumn("refers", F.when(~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper")))
    pieces = F.when(F.col("refers").isNotNull(), 1).otherwise(F.greatest(F.lit(1), F.ceil(F.col("size") / chunk).cast("int")))
    rows = rows.withColumn("chunks", pieces).withColumn("number", F.explode(F.sequence(F.lit(1), "chunks")))
    part = F.when(F.col("refers").isNotNull(), F.lit(b"")).otherwise(F.substring("body", (F.col("number") - 1) * chunk + 1, F.lit(chunk)))
    return rows.select("page_id", "url", "sha1", "size", "refers", "number", "chunks", part.alias("chunk"))


def _segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Chunk rows, in order, to WARC records as bytes without the last line end."""
    block = b"software: gridlark\r\nformat: WARC File Format 1.1\r\n"
    out = [_VERSION + _header([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{_SPACE}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields"), ("Content-Length", len(block))]) + block + b"\r\n"]
    sofar, number = hashlib.sha1(), 0
    for b in batches:
        for page, url, sha1, size, refers, chunk_no, chunks, chunk in zip(b.page_id, b.url, b.sha1, b["size"], b.refers, b.number, b.chunks, b.chunk, strict=True):
            if chunk_no == 1:
                sofar, number = hashlib.sha1(), 0
            page = None if pd.isna(page) else int(page)
            refers = None if pd.isna(refers) else int(refers)
            me = record_id(page, sha1)
            pieces, at = [], 0
            while (hit := chunk.find(_VERSION[:-2], at)) >= 0:  # what the delimiter begins with is cut in two
                pieces.append(chunk[at : hit + 5])
                at = hit + 5
            pieces.append(chunk[at:])
            for k, piece in enumerate(pieces):
                number += 1
                sofar.update(piece)
                final = chunk_no == chunks and k == len(pieces) - 1
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() if number == 1 else b""
                fields = [
                    ("WARC-Type", "continuation" if number > 1 else "response" if refers is None else "revisit"),
                    ("WARC-Record-ID", me if number == 1 else f"<urn:uuid:{uuid.uuid5(_SPACE, f'{me}/{number}')}>"),
                    ("WARC-Date", DATE),
                    ("WARC-Target-URI", url),
                    ("Content-Type", "application/http; msgtype=response" if number == 1 else None),
                    ("WARC-Payload-Digest", f"sha1:{_base32(bytes.fromhex(sha1))}" if number == 1 else None),
                    ("WARC-Profile", None if refers is None else _PROFILE),
                    ("WARC-Refers-To", None if refers is None else record_id(refers, sha1)),
                    ("WARC-Segment-Number", number if number > 1 or not final else None),
                    ("WARC-Segment-Origin-ID", me if number > 1 else None),
                    ("WARC-Segment-Total-Length", size if final and number > 1 else None),
                    # extension fields: what the table needs and the standard has no name for
                    ("X-Page-ID", page),
                    ("X-Refers-To-Page-ID", refers),
                    ("X-Digest-So-Far", f"sha1:{_base32(sofar.digest())}" if refers is None else None),
                    ("Content-Length", len(http) + len(piece)),
                ]
                out.append(_VERSION + _header(fields) + http + piece + b"\r\n")
        yield pd.DataFrame({"value": out})
        out = []
    yield pd.DataFrame({"value": out})


def write_warc(pages: DataFrame, path: str, least: int = LEAST, chunk: int = CHUNK) -> None:
    """Write a record for each row of ``pages`` (``page_id, url, html``) as WARC files in the folder ``path``.

    Null pages have empty payloads. Of rows with equal payloads of at least ``least`` bytes the one with the largest
    page_id is a response, and the others revisit it; rows that repeat that id too are responses, and so are rows
    without an id whose payload no row with an id has. Other columns are not written.
    """
    segments = chunk_rows(pages, least, chunk).mapInPandas(_segments, "value binary")
    segments.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\r\n").text(path)


CHUNK_SCHEMA = "record string, number int, total long, type string, page_id long, refers_to long, size long, digest string, so_far string, payload binary"


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in CHUNK_SCHEMA.split(", ")]
    for b in batches:
        out = []
        for raw in b.value:
            raw = bytes(raw)
            head, _, rest = raw.partition(b"\r\n\r\n")
            h = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n"))
            n = int(h["Content-Length"])
            if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
                raise ValueError(f"damaged record {h.get('WARC-Record-ID')}: {len(rest) - 4} bytes instead of {n}")
            kind, block, size, digest = h["WARC-Type"], rest[:n], None, None
            if kind == "warcinfo":
                continue
            if kind != "continuation":
                http, _, block = block.partition(b"\r\n\r\n")
                size = int(http.lower().rpartition(b"content-length: ")[2].split(b"\r\n")[0])
                digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
            page, refers = h.get("X-Page-ID"), h.get("X-Refers-To-Page-ID")
            total = -1 if kind == "revisit" or "WARC-Segment-Number" not in h else int(h.get("WARC-Segment-Total-Length", 0))
            so_far = h.get("X-Digest-So-Far", "").removeprefix("sha1:")
            out.append((h.get("WARC-Segment-Origin-ID", h["WARC-Record-ID"]), int(h.get("WARC-Segment-Number", 1)), total, kind, page and int(page), refers and int(refers), size, digest, so_far, block))
        yield pd.DataFrame(out, columns=names).astype({"page_id": "Int64", "refers_to": "Int64", "size": "Int64"})


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunked record table of the WARC files in ``path``: see ``CHUNK_SCHEMA``; ``total`` is -1 for a record of one segment."""
    lines = spark.read.option("lineSep", _VERSION.decode()).text(path).filter("value <> ''")
    return lines.select(F.col("value").cast("binary").alias("value")).mapInPandas(_parse, CHUNK_SCHEMA)


RECORD_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _record(first, length: int, sha1: bytes) -> tuple:
    """The record that begins with segment ``first``; what was read must be what its headers say."""
    if first.type == "revisit":
        return (first.page_id, first.size, first.digest, "revisit", first.refers_to)
    if length != first.size or _base32(sha1) != first.digest:
        raise ValueError(f"damaged payload of {first.record}: {length} bytes instead of {first.size}")
    return (first.page_id, length, first.digest, "response", None)


def _frame(records: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(records, columns=[c.split()[0] for c in RECORD_SCHEMA.split(", ")]).astype({"page_id": "Int64", "payload_bytes": "Int64", "refers_to": "Int64"})


def _single_records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Records of one segment, finished, beside the segments of longer ones as they are."""
    for b in batches:
        one = _frame([_record(r, len(r.payload), hashlib.sha1(r.payload).digest()) for r in b[b.total == -1].itertuples(index=False)])
        done = pd.DataFrame(None, index=one.index, columns=b.columns, dtype=object).assign(number=0, total=-1, page_id=one.page_id, refers_to=one.refers_to, size=one.payload_bytes, digest=one.payload_digest, type=one.record_type)
        yield b[b.total != -1]
        yield done


def _long_records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Finished records as they are; segments, sorted by record and number, to records. Equal rows' segments come as often as the rows do, and count once."""
    now, times, last, length, sha = None, 0, 0, 0, hashlib.sha1()
    for b in batches:
        out = []
        for r in b.itertuples(index=False):
            if r.number == 0:
                out.append((r.page_id, r.size, r.digest, r.type, r.refers_to))
            elif now is not None and r.record == now.record and r.number == last:
                times += r.number == 1
            elif r.number == 1:
                if now is not None:
                    out += [_record(now, length, sha.digest())] * times
                now, times, last, length, sha = r, 1, 0, 0, hashlib.sha1()
            elif now is None or r.record != now.record or r.number != last + 1:
                raise ValueError(f"segment {r.number} of {r.record} follows segment {last}")
            if r.number > last or (r.number == 1 and last == 0):
                last = r.number
                length += len(r.payload)
                sha.update(r.payload)
                if _base32(sha.digest()) != r.so_far:
                    raise ValueError(f"damaged segment {r.number} of {r.record}")
        yield _frame(out)
    yield _frame([_record(now, length, sha.digest())] * times if now is not None else [])


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of the WARC files in ``path``, digests recomputed.

    Records of one segment are digested where they are read; only the chunks of longer ones are shuffled with their
    payload, by record, and digested in order. A revisit's length and digest are those in its headers.
    """
    seen = read_chunks(spark, path).mapInPandas(_single_records, CHUNK_SCHEMA)
    spread = F.coalesce(F.col("record"), F.col("page_id").cast("string"), F.lit(""))
    return seen.repartition(spread).sortWithinPartitions("record", "number").mapInPandas(_long_records, RECORD_SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: every page written to WARC files and read back."""
    path = scratch_path(spark, "warc")
    write_warc(read_table(spark, sf_dir, "pages"), path)
    return read_records(spark, path)


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, body, sha1(body) || '0' AS hex, max(page_id) OVER (PARTITION BY body) AS keeper FROM p)
SELECT page_id, octet_length(encode(body))::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         ((('0x' || substr(hex, (i * 5 // 4 + 1)::INT, 2))::INT >> (3 - i * 5 % 4)::INT) & 31) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = keeper OR keeper IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = keeper OR keeper IS NULL THEN NULL ELSE keeper END AS refers_to
FROM d"""

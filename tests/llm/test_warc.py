import base64
import hashlib
import random
import uuid

import pytest
from gridlark.llm import warc as W
from gridlark.llm.common import scratch_path


def pages():
    rnd = random.Random(6)
    bodies = [None, "", "same", "same", "é" * 7, "WARC/1.1\r\n" * 9, "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n", "x" * 5000, "x" * 5000, "\r\n\r\n", "\0\x0b", "ends WARC/1.1", "WARC/1.1"]
    bodies += ["".join(rnd.choices("ab\r\nWARC/1.é🙂 ", k=rnd.randint(0, 300))) for _ in range(60)] + ["ümlaut" * 2000] * 3
    rows = [(i, f"http://x/{i}\r\nX: y WARC/1.1" if i % 5 else None, b, 1) for i, b in enumerate(bodies)]
    return [*rows, (7, "again", "x" * 5000, 1), (8, "again", "x" * 5000, 1), (8, "again", "x" * 5000, 1), (None, None, "nobody has this", 1), (None, "u", "same", 1), (None, "u", "x" * 9000, 1), (None, "u", "x" * 9000, 1)]


def expected(rows, least):
    best = {}
    for i, _, b, _ in rows:
        if i is not None:
            best[b or ""] = max(i, best.get(b or "", i))
    out = []
    for i, _, b, _ in rows:
        raw = (b or "").encode()
        keep = best.get(b or "") if len(raw) >= least else None
        refers = keep if keep is not None and keep != i else None
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if refers is not None else "response", refers))
    return sorted(map(repr, out))


@pytest.mark.parametrize(("least", "chunk"), [(0, W.CHUNK), (5, 16), (0, 1000)])
def test_round_trip(spark, least, chunk):
    rows = pages()
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, record int").repartition(3)
    path = scratch_path(spark, "test-warc")
    W.write_warc(frame, path, least, chunk)
    got = W.read_records(spark, path).collect()
    assert sorted(repr((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got) == expected(rows, least)
    chunks = W.read_chunks(spark, path)
    assert max(len(r.payload) for r in chunks.collect()) <= chunk
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        assert W.read_records(spark, path).count() == len(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_files_are_warc(spark):
    path = scratch_path(spark, "test-warc")
    W.write_warc(spark.createDataFrame([(1, "http://a/", "p" * 50)], "page_id long, url string, html string").coalesce(1), path, chunk=20)
    raw = b"".join(bytes(r.content) for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).collect())
    kinds, payload = [], b""
    while raw:
        head, _, rest = raw.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        assert lines[0] == "WARC/1.1"
        h = dict(x.split(": ", 1) for x in lines[1:])
        n = int(h["Content-Length"])
        uuid.UUID(h["WARC-Record-ID"][10:-1])
        kinds.append(h["WARC-Type"])
        if h["WARC-Type"] != "warcinfo":
            payload += rest[:n].rpartition(b"\r\n\r\n")[2]
        assert rest[n : n + 4] == b"\r\n\r\n"
        raw = rest[n + 4 :]
    assert kinds == ["warcinfo", "response", "continuation", "continuation"] and payload == b"p" * 50


def test_empty_table(spark):
    path = scratch_path(spark, "test-warc")
    W.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert W.read_records(spark, path).count() == 0

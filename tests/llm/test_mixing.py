import duckdb
import pytest
from pyspark.sql import functions as F

from gridlark.llm import mixing as M


def rows():
    out = []
    for s, n in (("a", 60), ("b", 200), ("Z", 15), (None, 30), ("é", 5), ("empty", 3)):
        for i in range(n):
            out.append((len(out), "" if s == "empty" else " ".join(["w"] * (1 + (i * 7) % 40)), s, 5, "x"))
    return [*out, (0, "w w w", "a", 5, "x"), (0, "w w w", "a", 5, "x"), (None, "w\x0bw\x85w", "b", 5, "x"), (9999, None, "b", 5, "x")]


def expected_targets(sizes):
    """Reshare the excess until no source is above three times its size."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    target, open_, pool = dict.fromkeys(names, 0.0), set(names), float(sum(sizes.values()))
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * pool / total >= 3 * sizes[s]}
        if not full:
            return target | {s: weight[s] * pool / total for s in open_}
        for s in full:
            target[s] = 3.0 * sizes[s]
        pool -= sum(3 * sizes[s] for s in full)
        open_ -= full
    return target


def test_mix_against_definition_and_sql(spark):
    data = rows()
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, size int, target string")
    got = M.mix(docs).collect()
    assert len(got) == len(data)
    sizes = {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    want = expected_targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r.source_size == sizes[r.source] and 0 <= r.copies <= 3
        assert r.target == pytest.approx(want[r.source])
        taken[r.source] += r.size * r.copies
    assert all(abs(taken[s] - want[s]) <= 20 for s in sizes)
    import pandas as pd

    con = duckdb.connect()
    con.register("docs_frame", pd.DataFrame(data, columns=["doc_id", "text", "source", "size", "target"]).astype({"doc_id": "Int64"}))
    con.execute("create view documents as select doc_id, text, source from docs_frame")
    sql = sorted(repr(x) for x in con.execute(f"select doc_id, size, taken from ({M.oracle()})").fetchall())
    assert sql == sorted(repr((r.doc_id, r.size, r.size * r.copies)) for r in got)
    mixed = M.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r.copies for r in got if r.size)


def test_probabilities_differ_within_a_source_and_carry_the_draw(spark):
    """Documents of a larger size class are likelier to be drawn; with one probability a source the shares would be alike."""
    data = [(i, " ".join(["w"] * (4 if i % 2 else 40)), "a" if i < 4000 else "b") for i in range(6000)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = [r for r in M.mix(docs).collect() if r.source == "a"]
    share = {n: sum(r.copies for r in got if r.size == n) / 2000 for n in (4, 40)}
    sized = M._sized(docs, F.col("doc_id").alias("id"), "doc_id", "text", "source", M.SEED)
    plan = {r.source: r for r in M.mix_plan(sized).collect()}["a"]
    want = {4: min(1, plan.c * 4), 40: min(1, plan.c * 32)}
    assert 0 < want[4] < want[40] <= 1
    for n, p in want.items():
        assert abs(share[n] - p) < 0.05
    assert abs(sum(r.size * r.copies for r in got) - got[0].target) <= 20


def test_repeated_rows_and_long_texts(spark):
    """Equal rows at the cut: as many are taken as are needed, none is sorted by id."""
    data = [(None, "w w w", "a", 1)] * 500 + [(1, "w " * 400_000, "b", 2), (2, "w " * 200_000, "b", 3)]
    docs = spark.createDataFrame(data, "doc_id string, text string, source string, copies int").repartition(7)
    got = M.mix(docs).collect()
    for s in ("a", "b"):
        rows = [r for r in got if r.source == s]
        assert abs(sum(r.size * r.copies for r in rows) - rows[0].target) <= max(r.size for r in rows)
    mixed = M.mixed_documents(docs)
    assert mixed.filter("source = 'a'").count() == sum(r.copies for r in got if r.source == "a")


def test_columns_with_the_helpers_names_stay(spark):
    names = "row u rank p size copies whole extra of c tied part __n __k __copies __id __size __source cut_rank col missing target source_size".split()
    data = [(i, "w " * (i % 9), "ab"[i % 2], *(f"{n}{i}" for n in names)) for i in range(60)] * 2
    docs = spark.createDataFrame(data, ["doc_id", "text", "source", *names])
    mixed = M.mixed_documents(docs)
    assert mixed.columns == docs.columns
    taken = {tuple(r) for r in mixed.collect()}
    assert taken and taken <= {tuple(d) for d in data}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert M.mix(docs).count() == 0 and M.mixed_documents(docs).count() == 0

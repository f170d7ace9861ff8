import numpy as np
from gridlark.llm import hnsw as H


def vectors(seed=1):
    rng = np.random.default_rng(seed)
    far = rng.normal(size=(900, 24))
    near = far[:40] + rng.normal(size=(40, 24)) * 0.05
    tight = rng.normal(size=24) + rng.normal(size=(150, 24)) * 0.02
    loose = 3 * rng.normal(size=24) / 24**0.5 + rng.normal(size=(120, 24)) * 0.12
    chain = [np.cos(a) * np.eye(24)[0] + np.sin(a) * np.eye(24)[1] for a in np.linspace(0, 2.5, 30)]
    return np.concatenate([far, near, tight, loose, chain])


def brute(x):
    """Number of links and smallest index of the component for each row; rows of zeros link with nothing."""
    n = np.linalg.norm(x, axis=1)
    u = x / np.where(n == 0, 1, n)[:, None]
    link = u @ u.T >= H.THRESHOLD
    np.fill_diagonal(link, False)
    root = np.arange(len(x))
    while True:
        low = np.where(link, root[None, :], len(x)).min(axis=1)
        new = np.minimum(root, low)
        if (new == root).all():
            return link.sum(axis=1), root
        root = new[new]


def test_shard_against_brute_force():
    x = vectors()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    index = H.build_shard(np.arange(len(u)), u, np.ones(len(u), np.int64))
    assert sorted(index["members"].tolist()) == list(range(len(u)))
    links, edges, _, audit = H.query_shard(index, np.arange(len(u)), u, H.BEAM)
    assert audit[1] > 0 and audit[0] >= H.RECALL * audit[1]
    want, root = brute(x)
    assert links.sum() >= 0.99 * want.sum() and (links <= want).all()
    for a, b in edges:
        assert root[a] == root[b]
    found = H._reach(index, u[:200], 4)
    wide = H._reach(index, u[:200], len(u))
    assert sum(len(np.intersect1d(a, b)) for a, b in zip(found, wide, strict=True)) >= 0.9 * sum(map(len, wide))


def test_an_index_opens_as_it_was_packed():
    x = vectors(3).astype(np.float32)
    index = H.build_shard(np.arange(len(x)), H.unit(x), np.ones(len(x), np.int64))
    again = H.open_index(H.pack_index(index, x))
    for key in ("rid", "x", "leader", "of", "radius", "members", "begin", "total"):
        assert np.array_equal(index[key], again[key])
    for a, b in zip(index["graph"].search(x[:50], 8), again["graph"].search(x[:50], 8), strict=True):
        assert np.array_equal(a, b)


def test_shards_are_bounded_in_bytes(spark, monkeypatch):
    monkeypatch.setattr(H, "SHARD_BYTES", 300 * 24 * 8)
    x = vectors(5)
    frame = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    sizes = []
    real = H.materialise
    monkeypatch.setattr(H, "materialise", lambda df, name: (out := real(df, name), sizes.extend(r.n for r in out.collect()) if name == "hnsw-index" else None)[0])
    got = {r.vec_id: r for r in H.embedding_components(frame).collect()}
    assert len(sizes) >= 5 and max(sizes) <= 300 * 1.3
    want, root = brute(x)
    assert sum(got[i].n_links == n and got[i].component_id == r for i, (n, r) in enumerate(zip(want, root, strict=True))) >= 0.99 * len(x)


def test_recall_of_the_bare_graph():
    rng = np.random.default_rng(4)
    u = rng.normal(size=(3000, 32))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    index = H.build_shard(np.arange(3000), u, np.ones(3000, np.int64))
    q = u[::50] + rng.normal(size=(60, 32)) * 0.02
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    ids, _ = index["graph"].search(q.astype(np.float32), H.BEAM)
    best = (q @ u[index["leader"]].T).argmax(axis=1)
    assert (ids[:, 0] == best).mean() >= 0.9


def test_query_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(H, "SMALL", 300)
    monkeypatch.setattr(H, "TASK", 700)
    x = vectors(2)
    rows = [(3 * i + 1, [float(v) for v in r], "c") for i, r in enumerate(x)]
    copies = [(9000 + i, [v * 2 for v in rows[5][1]] if i % 2 else rows[5][1], "c") for i in range(40)]
    plain = x.tolist() + [c[1] for c in copies]
    odd = [(20000, None, "c"), (20001, [], "c"), (20002, [0.0] * 24, "c"), (20003, [1.0, None] + [0.0] * 22, "c"), (20004, [float("nan")] * 24, "c"), (20005, [float("inf")] + [1.0] * 23, "c"), (20006, [1.0, 0.5], "c"), (20007, [1.0, 0.51], "c")]
    frame = spark.createDataFrame(rows + copies + odd + [(None, [float(v) for v in x[7]], "c")], "vec_id long, embedding array<double>, component_id string").repartition(4)
    got = H.embedding_components(frame).collect()
    assert len(got) == len(rows) + len(copies) + len(odd) + 1
    by = {r.vec_id: r for r in got}
    plain.append(x[7].tolist())
    want, root = brute(np.array(plain))
    ids = [r[0] for r in rows] + [c[0] for c in copies] + [None]
    low = {}
    for i, r in zip(ids, root, strict=True):
        if i is not None:
            low[r] = min(i, low.get(r, i))
    exact = sum(by[i].n_links == n and by[i].component_id == low[r] for i, n, r in zip(ids, want, root, strict=True))
    assert exact >= 0.99 * len(ids)
    assert all(by[i].kept == (i is not None and by[i].component_id == i) for i in ids)
    for i, *_ in odd[:6]:
        assert (by[i].n_links, by[i].component_id, by[i].kept) == (0, i, True)
    assert (by[20006].n_links, by[20007].component_id, by[20007].kept) == (1, 20006, False)


def test_empty_table(spark):
    assert H.embedding_components(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_audits_reach_the_stated_recall(spark, monkeypatch):
    """Every task's sample, against an exact comparison; tasks are shards, or as many parts of them as there are cores."""
    monkeypatch.setattr(H, "SMALL", 300)
    monkeypatch.setattr(H, "TASK", 50)
    x = vectors(6)
    frame = spark.createDataFrame([(i, len(r), [float(v) for v in r], 1) for i, r in enumerate(x)], "rid long, dim int, vec array<double>, n long")
    audits = H.vector_links(frame).filter("rid is null").select("reached", "expected").collect()
    assert 4 <= len(audits) <= spark.sparkContext.defaultParallelism + 4
    assert sum(a.expected for a in audits) > 0 and sum(a.reached for a in audits) >= H.RECALL * sum(a.expected for a in audits)

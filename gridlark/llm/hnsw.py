"""Embedding near-duplicates: a hierarchical navigable small-world graph for each shard, queried by every vector.

Distinct vectors are dealt to shards of bounded bytes. A shard keeps leaders: a vector within ``RADIUS`` of a leader
joins it as a member, others become leaders and enter the graph, so that dense groups neither fill the graph's
neighbour lists nor are expanded into pairs. Every vector searches every shard for the leaders whose members may
link with it. By the triangle inequality on angles a near leader's members all link, a far one's do not, and only the
members of leaders in between are compared, in double precision.

Each index is written once to the shared folder. A search task takes a slice of one shard's vectors and opens the
shards' indexes one after another by path, so neither indexes nor queries are shuffled and a task holds one index
beside its slice.

A beam that is full of leaders within reach is doubled for its query, up to an exact comparison with all leaders. In
every task a sample of the queries is compared with all leaders; while less than ``RECALL`` of what they should reach
was found, all beams of the task are doubled. A task reports a count for each query, one star of links for each of
its components, and what its audits found.
"""

from __future__ import annotations

import logging
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, materialise

log = logging.getLogger(__name__)

THRESHOLD = 0.95
#: Angle within which a vector joins a leader: two members of one leader are then within the threshold's angle.
RADIUS = 0.49 * math.acos(THRESHOLD)
#: Shards to build side by side, vectors for which one more of them pays, and bytes of a shard's vectors at most.
SHARDS, SMALL, SHARD_BYTES = 4, 1024, 64 << 20
#: Queries of a task at least, and of a search; graph neighbours, beam when building and when searching, audited queries, recall.
TASK, BLOCK, NEIGHBOURS, BUILD_BEAM, BEAM, AUDITED, RECALL = 4_096, 256, 12, 32, 16, 64, 0.995
#: Nodes of a level that are compared directly to find where a search begins; neighbour lists that are chosen at a time.
TOP, CHOSEN = 2_048, 512
_MARGIN = 1e-6


# ---------------------------------------------------------------- graph
def _best(ids: np.ndarray, sim: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``width`` best of each row, best first."""
    if ids.shape[1] > width:
        part = np.argpartition(-sim, width - 1, axis=1)[:, :width]
        ids, sim = np.take_along_axis(ids, part, axis=1), np.take_along_axis(sim, part, axis=1)
    order = np.argsort(-sim, axis=1, kind="stable")
    return np.take_along_axis(ids, order, axis=1), np.take_along_axis(sim, order, axis=1)


def _padded(row: np.ndarray, rows: int, values: tuple[np.ndarray, ...], fill: tuple) -> list[np.ndarray]:
    """Values of ascending ``row`` numbers as matrices, one line a row, filled up."""
    count = np.bincount(row, minlength=rows)
    place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    out = [np.full((rows, int(count.max(initial=0))), f, v.dtype) for v, f in zip(values, fill, strict=True)]
    for o, v in zip(out, values, strict=True):
        o[row, place] = v
    return out


class Graph:
    """Navigable small-world graph over unit vectors, grown and searched in batches."""

    def __init__(self, dim: int, seed: int = 1):
        self.x, self.n = np.zeros((64, dim), np.float32), 0
        self.near = [np.full((64, 2 * NEIGHBOURS), -1, np.int32)]
        self.level = np.zeros(64, np.int8)
        self.rng = np.random.default_rng(seed)

    def _room(self, n: int) -> None:
        if n > len(self.x):
            size = max(n, 2 * len(self.x))
            grow = lambda a, fill: np.concatenate([a, np.full((size - len(a), *a.shape[1:]), fill, a.dtype)])
            self.x, self.level = grow(self.x, 0), grow(self.level, 0)
            self.near = [grow(a, -1) for a in self.near]

    def _beam(self, q: np.ndarray, level: int, entry: np.ndarray, width: int, steps: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """Beam search of many queries in step: ids and similarities, best first. ``steps`` nodes of a beam are followed a round."""
        b, n, near, x = len(q), self.n, self.near[level], self.x
        seen = np.zeros(b * n, bool)
        ids, sim, done = np.full((b, width), -1, np.int32), np.full((b, width), -2, np.float32), np.ones((b, width), bool)
        entry = entry[:, :width]
        k = entry.shape[1]
        ids[:, :k], done[:, :k] = entry, entry < 0
        sim[:, :k] = np.where(entry >= 0, np.einsum("bd,bkd->bk", q, x[entry]), -2)
        r, c = np.nonzero(entry >= 0)
        seen[r * n + entry[r, c]] = True
        live, steps = np.arange(b), min(steps, width)
        while len(live):
            open_sim = np.where(done[live], -3, sim[live])
            pick = np.argpartition(-open_sim, steps - 1, axis=1)[:, :steps] if steps < width else np.broadcast_to(np.arange(width), (len(live), width))
            at = live[:, None], pick
            to = near[np.maximum(ids[at], 0)]
            ok = (to >= 0) & ~done[at][:, :, None]
            done[at] = True
            flat = (live[:, None, None] * n + to)[ok]
            flat = np.sort(flat[~seen[flat]])
            flat = flat[np.append(True, flat[1:] != flat[:-1])] if len(flat) else flat
            seen[flat] = True
            r, c = np.divmod(flat, n)
            s = np.einsum("nd,nd->n", q[r], x[c])
            better = s > sim.min(axis=1)[r]
            r, c, s = r[better], c[better].astype(np.int32), s[better]
            if len(r):
                rows = np.flatnonzero(np.bincount(r, minlength=b))
                new_ids, new_sim, new_done = _padded(np.searchsorted(rows, r), len(rows), (c, s, np.zeros(len(r), bool)), (-1, -2, True))
                all_sim = np.concatenate([sim[rows], new_sim], axis=1)
                best = np.argpartition(-all_sim, width - 1, axis=1)[:, :width]
                ids[rows] = np.take_along_axis(np.concatenate([ids[rows], new_ids], axis=1), best, axis=1)
                done[rows] = np.take_along_axis(np.concatenate([done[rows], new_done], axis=1), best, axis=1)
                sim[rows] = np.take_along_axis(all_sim, best, axis=1)
            live = live[~done[live].all(axis=1)]
        return _best(ids, sim, width)

    def search(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and similarities of near nodes, best first: from the best nodes of an upper level down to all nodes."""
        if not self.n:
            return np.full((len(q), 1), -1, np.int32), np.full((len(q), 1), -2, np.float32)
        if width >= self.n:
            sim = q @ self.x[: self.n].T
            order = np.argsort(-sim, axis=1)
            return order.astype(np.int32), np.take_along_axis(sim, order, axis=1)
        top = next((k for k in range(len(self.near)) if np.count_nonzero(self.level[: self.n] >= k) <= TOP), len(self.near) - 1)
        nodes = np.flatnonzero(self.level[: self.n] >= top)[:TOP].astype(np.int32)
        if not len(nodes):
            nodes = np.array([int(np.argmax(self.level[: self.n]))], np.int32)
        entry = _best(np.broadcast_to(nodes, (len(q), len(nodes))), q @ self.x[nodes].T, width if top == 0 else 4)[0]
        for level in range(top - 1, 0, -1):
            entry = self._beam(q, level, entry, 4)[0]
        return self._beam(q, 0, entry, width)

    def _choose(self, ids: np.ndarray, sim: np.ndarray, most: int) -> np.ndarray:
        """Of each row's ids (-1: none) at most ``most``. Diverse ones first: those nearer to the point than to one chosen before; then the nearest of the others."""
        if ids.shape[1] <= most:
            return ids
        if len(ids) > CHOSEN:
            return np.concatenate([self._choose(ids[i : i + CHOSEN], sim[i : i + CHOSEN], most) for i in range(0, len(ids), CHOSEN)])
        ids, sim = _best(ids, np.where(ids >= 0, sim, -2), ids.shape[1])
        x = self.x[np.maximum(ids, 0)]
        between, rows = x @ x.transpose(0, 2, 1), np.arange(len(ids))
        chosen, open_ = np.zeros(ids.shape, bool), ids >= 0
        for _ in range(most):
            k = open_.argmax(axis=1)
            some = open_[rows, k]
            if not some.any():
                break
            chosen[rows[some], k[some]] = True
            open_ &= between[rows, k] < sim
            open_[rows, k] = False
        order = np.argsort(np.where(chosen, 0, np.where(ids >= 0, 1, 2)), axis=1, kind="stable")[:, :most]
        return np.take_along_axis(ids, order, axis=1)

    def _link(self, level: int, nodes: np.ndarray, ids: np.ndarray, sim: np.ndarray) -> None:
        """Give new ``nodes`` their neighbours out of ``ids``, and these the way back."""
        near = self.near[level]
        chosen = self._choose(ids, sim, NEIGHBOURS)
        near[nodes, : chosen.shape[1]] = chosen
        r, c = np.nonzero(chosen >= 0)
        to, back = chosen[r, c], nodes[r]
        order = np.lexsort((back, to))
        to, back = to[order], back[order]
        twice = (near[to] == back[:, None]).any(axis=1)  # nodes of one batch may have chosen each other
        to, back = to[~twice], back[~twice]
        targets, group = np.unique(to, return_inverse=True)
        if not len(targets):
            return
        (new,) = _padded(group, len(targets), (back,), (-1,))
        got = np.concatenate([near[targets], new], axis=1)
        got = np.take_along_axis(got, np.argsort(got < 0, axis=1, kind="stable"), axis=1)
        full = (got[:, near.shape[1] :] >= 0).any(axis=1)
        near[targets[~full]] = got[~full, : near.shape[1]]
        for i in range(0, int(full.sum()), CHOSEN):
            g, t = got[full][i : i + CHOSEN], targets[full][i : i + CHOSEN]
            near[t] = self._choose(g, np.einsum("bd,bkd->bk", self.x[t], self.x[np.maximum(g, 0)]), near.shape[1])

    def add(self, x: np.ndarray, found: tuple[np.ndarray, np.ndarray]) -> None:
        """Insert vectors; ``found``: what a search for them gave before."""
        first, b = self.n, len(x)
        self._room(first + b)
        self.x[first : first + b] = x
        self.level[first : first + b] = np.minimum(-np.log(1 - self.rng.random(b)) / math.log(NEIGHBOURS), 4).astype(np.int8)
        while len(self.near) <= self.level[first : first + b].max():
            self.near.append(np.full((len(self.x), NEIGHBOURS), -1, np.int32))
        self.n = first + b
        nodes, among = np.arange(first, first + b, dtype=np.int32), x @ x.T
        np.fill_diagonal(among, -2)
        others = _best(np.broadcast_to(nodes, (b, b)), among, NEIGHBOURS)
        others = np.where(others[1] > -2, others[0], -1), others[1]
        self._link(0, nodes, np.concatenate([found[0], others[0]], axis=1), np.concatenate([found[1], others[1]], axis=1))
        for level in range(1, len(self.near)):  # few nodes stand here: compared directly
            new = nodes[self.level[nodes] >= level]
            all_ = np.flatnonzero(self.level[: self.n] >= level).astype(np.int32)
            if len(new) and len(all_) > 1:
                sim = self.x[new] @ self.x[all_].T
                sim[all_[None, :] == new[:, None]] = -2
                ids, sim = _best(np.broadcast_to(all_, sim.shape), sim, BUILD_BEAM)
                self._link(level, new, np.where(sim > -2, ids, -1), sim)


# ---------------------------------------------------------------- shard
def unit(raw: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision."""
    x = raw.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def build_shard(rid: np.ndarray, x: np.ndarray, weight: np.ndarray) -> dict:
    """Index of a shard's unit vectors: graph over its leaders, and each leader's members (itself first), radius and weight."""
    graph, leaders, of = Graph(x.shape[1]), [], np.full(len(x), -1, np.int64)
    x32, at, size = x.astype(np.float32), 0, 1
    near = np.float32(math.cos(RADIUS) + 1e-5)
    while at < len(x):
        batch = np.arange(at, min(len(x), at + size))
        ids, sim = graph.search(x32[batch], BUILD_BEAM)
        old = sim[:, 0] >= near
        of[batch[old]] = ids[old, 0]
        rest = np.flatnonzero(~old)
        among, new = x32[batch[rest]] @ x32[batch[rest]].T, []
        for k in range(len(rest)):
            j = max(new, key=lambda j: among[k, j], default=None) if new and among[k, new].max() >= near else None
            if j is None:
                new.append(k)
                of[batch[rest[k]]] = len(leaders)
                leaders.append(int(batch[rest[k]]))
            else:
                of[batch[rest[k]]] = of[batch[rest[j]]]
        pick = rest[new]
        if len(pick):
            graph.add(x32[batch[pick]], (ids[pick], sim[pick]))
        at, size = at + size, min(BLOCK, 2 * size)
    leaders = np.array(leaders, np.int64)
    return _index(graph, rid, x, weight, leaders, of)


def _index(graph: Graph, rid: np.ndarray, x: np.ndarray, weight: np.ndarray, leaders: np.ndarray, of: np.ndarray) -> dict:
    order = np.lexsort((np.arange(len(x)) != leaders[of], of))
    angle = np.arccos(np.clip(np.einsum("nd,nd->n", x, x[leaders[of]]), -1, 1))
    radius = np.zeros(len(leaders))
    np.maximum.at(radius, of, angle)
    return {
        "graph": graph, "rid": rid, "x": x, "weight": weight, "leader": leaders, "of": of, "radius": radius,
        "members": order, "begin": np.searchsorted(of[order], np.arange(len(leaders) + 1)), "total": np.bincount(of, weights=weight, minlength=len(leaders)).astype(np.int64),
    }


def pack_index(index: dict, raw: np.ndarray) -> bytes:
    """What an index needs to be opened again: the vectors as they came, neighbour lists, leaders."""
    g = index["graph"]
    lists = [a[: g.n] for a in g.near]
    return pickle.dumps((index["rid"], raw, index["weight"], index["leader"], index["of"], g.level[: g.n], lists))


def open_index(packed: bytes) -> dict:
    rid, raw, weight, leaders, of, level, lists = pickle.loads(packed)
    x, graph = unit(raw), Graph(raw.shape[1])
    graph.n, graph.x, graph.level, graph.near = len(leaders), x[leaders].astype(np.float32), level, lists
    return _index(graph, rid, x, weight, leaders, of)


def _reach(index: dict, q: np.ndarray, width: int) -> list[np.ndarray]:
    """For each query the leaders whose members may link with it; a beam full of such leaders is doubled."""
    reach = np.cos(np.minimum(math.acos(THRESHOLD) + index["radius"] + 1e-3, math.pi))
    least, found, todo = reach.min(), [None] * len(q), np.arange(len(q))
    while len(todo):
        parts = [index["graph"].search(q[todo[i : i + BLOCK]].astype(np.float32), width) for i in range(0, len(todo), BLOCK)]
        ids, sim = (np.concatenate(p) for p in zip(*parts, strict=True))
        ok = (ids >= 0) & (sim >= reach[ids])
        full = (width < index["graph"].n) & (ids[:, -1] >= 0) & (sim[:, -1] >= least)
        for k in np.flatnonzero(~full):
            found[todo[k]] = ids[k, ok[k]]
        todo, width = todo[full], 2 * width
    return found


def query_shard(index: dict, rid: np.ndarray, q: np.ndarray, width: int) -> tuple[np.ndarray, list[tuple[int, int]], int, tuple[int, int]]:
    """Linked weight of each query (itself not counted), links ``(rid, rid of a leader)``, the beam that passed the audit, and what the audit found of what there is."""
    audited = np.argsort(rid * np.int64(0x9E3779B97F4A7C1) % np.int64(1_000_003), kind="stable")[:AUDITED]
    reach = np.cos(np.minimum(math.acos(THRESHOLD) + index["radius"] + 1e-3, math.pi))
    truth = [np.flatnonzero(row) for row in q[audited].astype(np.float32) @ index["graph"].x[: index["graph"].n].T >= reach]
    while True:
        found = _reach(index, q, width)
        hit = sum(len(np.intersect1d(t, found[a])) for t, a in zip(truth, audited, strict=True))
        if hit >= RECALL * sum(map(len, truth)) or width >= index["graph"].n:
            break
        width *= 2
    own = np.searchsorted(index["rid"], rid)
    own = np.where((own < len(index["rid"])) & (index["rid"][np.minimum(own, len(index["rid"]) - 1)] == rid), own, -1)
    pairs_q, pairs_l = [], []
    for k, f in enumerate(found):
        if own[k] >= 0 and index["of"][own[k]] not in f:  # its own leader is known without a search
            f = np.append(f, index["of"][own[k]])
        pairs_q.append(np.full(len(f), k))
        pairs_l.append(f)
    pq, pl = np.concatenate(pairs_q).astype(np.int64), np.concatenate(pairs_l).astype(np.int64)
    angle = np.arccos(np.clip(np.einsum("nd,nd->n", q[pq], index["x"][index["leader"][pl]]), -1, 1))
    links, edges, theta = np.zeros(len(q), np.int64), [], math.acos(THRESHOLD)
    sure = angle + index["radius"][pl] <= theta - _MARGIN
    same = own[pq] >= 0
    same[same] = index["of"][own[pq[same]]] == pl[same]
    weight = index["total"][pl] - np.where(same, index["weight"][np.maximum(own[pq], 0)], 0)
    np.add.at(links, pq[sure], weight[sure])
    edges += zip(rid[pq[sure]].tolist(), index["rid"][index["leader"][pl[sure]]].tolist(), strict=True)
    open_ = np.flatnonzero(~sure & (angle - index["radius"][pl] <= theta + _MARGIN))
    open_ = open_[np.argsort(pl[open_], kind="stable")]
    for group in np.split(open_, np.flatnonzero(np.diff(pl[open_])) + 1) if len(open_) else []:
        leader = pl[group[0]]
        members = index["members"][index["begin"][leader] : index["begin"][leader + 1]]
        for i in range(0, len(group), 1024):
            g = group[i : i + 1024]
            n, any_ = np.zeros(len(g), np.int64), np.zeros(len(g), bool)
            for j in range(0, len(members), 4096):
                m = members[j : j + 4096]
                linked = (q[pq[g]] @ index["x"][m].T >= THRESHOLD) & (own[pq[g]][:, None] != m[None, :])
                n += linked @ index["weight"][m]
                any_ |= linked.any(axis=1)
            links[pq[g]] += n
            edges += zip(rid[pq[g[any_]]].tolist(), [int(index["rid"][index["leader"][leader]])] * int(any_.sum()), strict=True)
    return links, edges, width, (hit, sum(map(len, truth)))


class _Stars:
    """Union of links; smallest member as root."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, a: int) -> int:
        p = self.parent
        while p.setdefault(a, a) != a:
            p[a] = p[p[a]]
            a = p[a]
        return a

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


# ---------------------------------------------------------------- Spark job
def _indexes(uri: str) -> Iterator[tuple[int, int, dict]]:
    """Shard, dimension and index of every index in a file of the shared folder."""
    import pyarrow.fs
    import pyarrow.parquet

    system, path = pyarrow.fs.FileSystem.from_uri(uri)
    with pyarrow.parquet.ParquetFile(path, filesystem=system) as file:
        for batch in file.iter_batches(batch_size=1, columns=["shard", "dim", "packed"]):
            for shard, dim, packed in zip(batch.column("shard").to_pylist(), batch.column("dim").to_pylist(), batch.column("packed"), strict=True):
                yield shard, dim, open_index(packed.as_buffer().to_pybytes())


def vector_links(distinct: DataFrame) -> DataFrame:
    """``rid, links, root, reached, expected`` rows for ``distinct``: ``rid long, dim int, vec array, n long``, valid vectors only.

    ``links``: weights ``n`` of the distinct vectors linked with ``rid``, where there are any; ``root`` ties nodes of
    one component together. A row without ``rid`` has a task's audit figures: leaders that its sample reached, and
    should have reached.
    """
    spark = distinct.sparkSession
    total, size = distinct.agg(F.count("*"), F.coalesce(F.sum("dim"), F.lit(0))).first()
    kind = np.float32 if distinct.schema["vec"].dataType.simpleString() == "array<float>" else np.float64
    shards = max(1, min(SHARDS, math.ceil(total / SMALL)), math.ceil(size * np.dtype(kind).itemsize / SHARD_BYTES))
    rows = distinct.withColumn("shard", F.pmod(F.xxhash64("rid"), F.lit(shards)).cast("int"))

    def build(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("rid")
        raw = np.stack([np.asarray(v, kind) for v in b.vec])
        index = build_shard(b.rid.to_numpy(np.int64), unit(raw), b.n.to_numpy(np.int64))
        return pd.DataFrame({"shard": [int(b.shard.iloc[0])], "dim": [raw.shape[1]], "n": [len(b)], "packed": [pack_index(index, raw)]})

    # a partition for each shard: small ones are not put together
    built = rows.repartitionByRange(shards, "shard").groupBy("shard", "dim").applyInPandas(build, "shard int, dim int, n long, packed binary")
    indexes = materialise(built, "hnsw-index")
    # a row for each shard comes to the driver: names and sizes
    sizes = indexes.select(F.col("_metadata.file_path").alias("file"), "shard", "dim", "n").orderBy("shard", "dim").collect()
    files = sorted({r.file for r in sizes})
    # a task opens every index, so it asks for as many vectors as it may: a shard's, or fewer where there are more cores than shards
    per = max(1, -(-spark.sparkContext.defaultParallelism // max(1, len(sizes))))
    slices = [(r.file, r.shard, r.dim, i, step) for r in sizes for step in (max(TASK, -(-r.n // per)),) for i in range(0, r.n, step)]

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for number in (int(i) for b in batches for i in b.id):
            file, shard, dim, at, step = slices[number]
            mine = next(index for k, d, index in _indexes(file) if (k, d) == (shard, dim))
            rid, q = mine["rid"][at : at + step], mine["x"][at : at + step].copy()
            del mine
            links, stars, width, reached, expected = np.zeros(len(rid), np.int64), _Stars(), BEAM, 0, 0
            for uri in files:
                for _, d, index in _indexes(uri):
                    if d != dim:
                        continue
                    for i in range(0, len(rid), BLOCK * 8):
                        n, edges, width, audit = query_shard(index, rid[i : i + BLOCK * 8], q[i : i + BLOCK * 8], width)
                        links[i : i + BLOCK * 8] += n
                        reached, expected = reached + audit[0], expected + audit[1]
                        for a, c in edges:
                            stars.union(a, c)
            nodes = np.array([a for a in stars.parent if stars.find(a) != a], np.int64)
            some = links > 0
            yield pd.DataFrame({
                "rid": pd.array([*rid[some].tolist(), *nodes.tolist(), None], "Int64"),
                "links": [*links[some].tolist(), *([0] * len(nodes)), 0],
                "root": pd.array([*rid[some].tolist(), *[stars.find(a) for a in nodes.tolist()], None], "Int64"),
                "reached": [0] * (int(some.sum()) + len(nodes)) + [reached], "expected": [0] * (int(some.sum()) + len(nodes)) + [expected],
            })

    return spark.range(0, len(slices), 1, max(1, len(slices))).mapInPandas(ask, "rid long, links long, root long, reached long, expected long")


def embedding_components(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Near-duplicate classes of vectors by cosine: ``<id_col>, n_links, component_id, kept``, one row for each row.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing and are components of
    their own; vectors of different length never link. Equal vectors are one for the search and count as often as
    they come; two hashes of 64 bits tell them from others. ``component_id`` is the smallest id of a component; null
    ids are never the smallest one and are not kept. An empty table gives an empty result. Other columns are not
    carried. The recall that the audits measured is logged.
    """
    kind = vectors.schema[vector_col].dataType.simpleString()
    vec = F.col(vector_col) if kind in ("array<float>", "array<double>") else F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("id"), vec.alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    rows = rows.withColumn("vec", F.when(finite, F.col("vec")))
    rows = rows.select("id", "vec", F.when(F.col("vec").isNotNull(), F.xxhash64("vec")).alias("h"), F.when(F.col("vec").isNotNull(), F.xxhash64(F.lit(1), "vec")).alias("h2"))
    distinct = rows.filter("vec is not null").groupBy("h", "h2").agg(F.first("vec").alias("vec"), F.min("id").alias("low"), F.count("*").alias("n"))
    distinct = materialise(distinct.withColumn("rid", F.monotonically_increasing_id()).withColumn("dim", F.size("vec")), "hnsw-vectors")
    found = materialise(vector_links(distinct.select("rid", "dim", "vec", "n")), "hnsw-links")
    audit = found.filter("rid is null").agg(F.sum("reached").alias("reached"), F.sum("expected").alias("expected")).first()
    log.info("audits reached %s of %s leaders", audit.reached, audit.expected)
    links = found.filter("links > 0").select("rid", "links")
    roots = connected_components(found.filter("rid <> root").select(F.col("rid").alias("src"), F.col("root").alias("dst")))
    names = distinct.select("rid", "low", "h", "h2", "n")
    rooted = names.join(roots.withColumnRenamed("node", "rid"), "rid")
    low = rooted.groupBy("root").agg(F.min("low").alias("component"))
    named = rooted.join(low, "root").select("rid", "component", F.lit(True).alias("in_class"))
    each = names.join(links, "rid", "left").join(named, "rid", "left")
    each = each.select("h", "h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.when(F.col("in_class"), F.col("component")).otherwise(F.col("low")).alias("component"), F.lit(True).alias("valid"))
    out = rows.select("id", "h", "h2").join(each, ["h", "h2"], "left")
    component = F.when(F.col("valid"), F.col("component")).otherwise(F.col("id"))
    out = out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: near-duplicate classes of all embeddings."""
    return embedding_components(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: All pairs and their closure: for small tables.
ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm
  FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)
  WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.95),
c AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT c.a, p.b FROM c JOIN p ON c.b = p.a)
SELECT vec_id, (SELECT count(*) FROM p WHERE p.a = vec_id)::BIGINT AS n_links,
       coalesce((SELECT min(b) FROM c WHERE c.a = vec_id), vec_id) AS component_id,
       coalesce((SELECT min(b) FROM c WHERE c.a = vec_id), vec_id) = vec_id AS kept
FROM embeddings"""

"""Approximate nearest neighbours: a hierarchical navigable small-world graph for each shard.

Equal vectors are one point of the index, with the least ids among them (as many as a search
can return), so copies neither crowd the links nor the beam. Points are dealt by a hash into
shards of bounded size. A shard's graph has layers: every point is in layer 0 and a
geometrically falling share in each layer above (its level comes from a hash, so a rebuilt
shard is the same). Each layer holds a flat array of neighbours, ``degree`` places for each
point (twice that in layer 0).

A layer is built by insertion, in batches that grow with it: a batch descends through the
finished layers above, walks the layer as it is so far and so finds its candidates, to which
the nearest of its own batch come. Links are chosen by the diversity rule of the method (a
candidate is linked if it is nearer to the point than to every neighbour chosen before) and
set both ways; a full list is thinned by the same rule. No point is compared with all others,
so the work grows with n log n and shards may be large.

Queries go in groups to every shard. A group walks the layers from the top, keeps a beam of
the best points seen, and always expands the best ones not yet expanded; many queries walk
at once. What the beam holds at the end is scored again on the original vectors in double
precision, and the shards' results are merged by query. A shard takes up to ``GREATEST``
points before there are more than ``SHARDS`` of them, as every pair of a shard and a group
of queries moves both.

Nearness is the inner product. It is turned into an angle by one more coordinate that gives
all vectors of the shard equal length, so the graph is a metric one and the order is exact.

Defined results: vectors that are null, empty, zero or hold null or non-finite components,
and rows without an id, take no part. Rows of one id are one candidate each if their
vectors differ and one if they agree; of several query rows with one id, the least vector
asks. Vectors of other dimensions are no candidates of a query. Equal scores go to the
smaller id. Fewer candidates than asked give fewer rows; an empty table gives none; other
columns may have any name and type.
"""

from __future__ import annotations

import struct
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoweave.llm.common import picked, prepare, stored

#: Points in a shard while there are few shards, the number of shards wanted, and the most points of one.
SHARD = 16_384
SHARDS = 64
GREATEST = 1 << 20
#: Queries in a group, which meets a shard in one task, and bytes of marks for those that walk at once.
GROUP = 1 << 15
MARKS = 16 << 20
DEGREE = 16
CANDIDATES = 48
BEAM = 128
K = 20
_EXPAND = 8
_SEEDS = 256
_BATCH = 1024


def _lifted(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors with one more coordinate, whose angles to a query are in the order of the inner products."""
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max()
    square = (v**2).sum(axis=1)
    most = square.max()
    return np.concatenate([v / np.sqrt(most), np.sqrt(np.maximum(0, 1 - square / most))[:, None]], axis=1).astype(np.float32)


def _mixed(ids: np.ndarray) -> np.ndarray:
    x = ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _levels(ids: np.ndarray, degree: int) -> np.ndarray:
    """Layer of each point from a hash of its id."""
    u = (_mixed(ids) >> np.uint64(11)).astype(np.float64) / (1 << 53)
    return np.floor(-np.log(np.maximum(u, 1e-18)) / np.log(degree)).astype(np.int64)


def _diverse(vectors: np.ndarray, near: np.ndarray, sims: np.ndarray, keep: int) -> np.ndarray:
    """Which candidates (rows by falling similarity, -1 for none) to link: diverse ones first, then the nearest of the others."""
    k = near.shape[1]
    among = vectors[near]
    among = among @ among.transpose(0, 2, 1)
    chosen = np.zeros(near.shape, bool)
    closest = np.full(near.shape, -np.inf, np.float32)  # of each candidate to the chosen ones
    for j in range(k):
        chosen[:, j] = (sims[:, j] > closest[:, j]) & (near[:, j] >= 0) & (chosen.sum(axis=1) < keep)
        closest = np.maximum(closest, np.where(chosen[:, j, None], among[:, j], -np.inf))
    order = np.argsort(np.where(near < 0, 2, ~chosen), axis=1, kind="stable")[:, :keep]
    return np.take_along_axis(near, order, axis=1)


def _sorted(vectors: np.ndarray, points: np.ndarray, near: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The nearest ``most`` of each point's candidates (-1 for none), by falling similarity, and these."""
    sims = np.einsum("nkd,nd->nk", vectors[near], vectors[points], optimize=True)
    sims[near < 0] = -np.inf
    order = np.argsort(-sims, axis=1, kind="stable")[:, :most]
    return np.take_along_axis(near, order, axis=1), np.take_along_axis(sims, order, axis=1)


def _walk(vectors: np.ndarray, q: np.ndarray, entry: np.ndarray, row_of: np.ndarray, near: np.ndarray, beam: int) -> np.ndarray:
    """Best-first search of one layer for all queries, from their entry points: (queries, beam) of the best, -1 where fewer were."""
    n, rows = len(vectors), np.arange(len(q))[:, None]
    seen = np.zeros((len(q), n + 1), bool)  # the last column stands for no point
    seen[:, n] = True
    entry = np.where(entry < 0, n, entry)
    seen[rows, entry] = True
    held = np.full((len(q), beam), n, np.int64)
    sims = np.full((len(q), beam), -np.inf, np.float32)
    m = min(beam, entry.shape[1])
    first = np.where(entry < n, np.einsum("qkd,qd->qk", vectors[np.minimum(entry, n - 1)], q), -np.inf)
    order = np.argsort(-first, axis=1, kind="stable")[:, :m]
    held[:, :m], sims[:, :m] = np.take_along_axis(entry, order, axis=1), np.take_along_axis(first, order, axis=1)
    done = ~np.isfinite(sims)
    active = np.flatnonzero(~done.all(axis=1))
    while len(active):
        todo = np.argsort(done[active], axis=1, kind="stable")[:, :_EXPAND]  # held is in falling order
        at = active[:, None]
        fresh = ~done[at, todo]
        done[at, todo] = True
        place = np.where(fresh, held[at, todo], n)
        new = np.where(place[:, :, None] < n, near[row_of[np.minimum(place, n - 1)]], -1).reshape(len(active), -1)
        new = np.sort(np.where(new < 0, n, new), axis=1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = n
        new[seen[at, new]] = n
        seen[at, new] = True
        width = int((new < n).sum(axis=1).max())
        if width:
            new = np.sort(new, axis=1)[:, :width]
            got = np.einsum("qkd,qd->qk", vectors[np.minimum(new, n - 1)], q[active], optimize=True)
            got[new == n] = -np.inf
            all_held, all_sims = np.concatenate([held[active], new], axis=1), np.concatenate([sims[active], got], axis=1)
            all_done = np.concatenate([done[active], new == n], axis=1)
            best = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
            held[active], sims[active], done[active] = (np.take_along_axis(x, best, axis=1) for x in (all_held, all_sims, all_done))
        active = active[~done[active].all(axis=1)]
    return np.where(held < n, held, -1)


class _Layer:
    """A layer that grows: the points in it and their neighbours, with room for twice ``width`` until it is finished."""

    def __init__(self, vectors: np.ndarray, members: np.ndarray, width: int):
        self.vectors, self.members, self.width = vectors, members, width
        self.row_of = np.full(len(vectors), -1, np.int64)
        self.row_of[members] = np.arange(len(members))
        self.near = np.full((len(members), 2 * width), -1, np.int32)
        self.count = np.zeros(len(members), np.int64)

    def link(self, points: np.ndarray, near: np.ndarray) -> None:
        """Link new points to their candidates (rows of places, -1 for none), both ways."""
        near, sims = _sorted(self.vectors, points, near, near.shape[1])
        links = _diverse(self.vectors, near, sims, self.width * 3 // 4)
        self._append(np.repeat(points, links.shape[1])[links.reshape(-1) >= 0], links.reshape(-1)[links.reshape(-1) >= 0])
        self._append(links.reshape(-1)[links.reshape(-1) >= 0], np.repeat(points, links.shape[1])[links.reshape(-1) >= 0])

    def _append(self, of: np.ndarray, to: np.ndarray) -> None:
        order = np.argsort(of, kind="stable")
        rows, to = self.row_of[of[order]], to[order]
        old = (self.near[rows] == to[:, None]).any(axis=1)  # linked from the other side before
        rows, to = rows[~old], to[~old]
        if not len(rows):
            return
        starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        sizes = np.diff(np.r_[starts, len(rows)])
        slot = self.count[rows] + np.arange(len(rows)) - np.repeat(starts, sizes)
        fits = np.repeat(self.count[rows[starts]] + sizes <= 2 * self.width, sizes)
        self.near[rows[fits], slot[fits]] = to[fits]
        ok = fits[starts]
        self.count[rows[starts[ok]]] += sizes[ok]
        full = np.flatnonzero(~ok)
        for i in range(0, len(full), 128):  # lists without room for all: thinned, the new ones among the old
            part = full[i : i + 128]
            most = int(sizes[part].max())
            extra = np.full((len(part), most), -1, np.int64)
            for k, g in enumerate(part.tolist()):
                extra[k, : sizes[g]] = to[starts[g] : starts[g] + sizes[g]]
            self._thin(rows[starts[part]], extra)

    def _thin(self, rows: np.ndarray, extra: np.ndarray) -> None:
        near, sims = _sorted(self.vectors, self.members[rows], np.concatenate([self.near[rows].astype(np.int64), extra], axis=1), 2 * self.width)
        kept = _diverse(self.vectors, near, sims, self.width)
        self.near[rows] = -1
        self.near[rows, : kept.shape[1]] = kept
        self.count[rows] = (kept >= 0).sum(axis=1)

    def finished(self) -> np.ndarray:
        over = np.flatnonzero(self.count > self.width)
        for i in range(0, len(over), 256):
            self._thin(over[i : i + 256], np.empty((len(over[i : i + 256]), 0), np.int64))
        return np.ascontiguousarray(self.near[:, : self.width])


class Graph:
    """A shard: the ids of each point, its vector, and for each layer its members and their flat neighbour array."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray, vectors: np.ndarray, members: list[np.ndarray], neighbours: list[np.ndarray]):
        self.ids, self.counts, self.vectors, self.members, self.neighbours = ids, counts, vectors, members, neighbours

    @classmethod
    def build(cls, ids: np.ndarray, counts: np.ndarray, vectors: np.ndarray, degree: int = DEGREE, candidates: int = CANDIDATES) -> Graph:
        """``ids`` of all points end to end, ``counts`` of them for each point, in order of a point's least id."""
        first = ids[np.cumsum(counts) - counts]
        lifted, levels = _lifted(vectors), _levels(first, degree)
        by_hash = np.argsort(_mixed(first ^ np.int64(0x5DEECE66D)), kind="stable")
        graph = cls(ids, counts, vectors, [], [])
        above: list[tuple[np.ndarray, np.ndarray]] = []  # (members, neighbours), from the top
        before = np.empty(0, np.int64)
        for level in range(int(levels.max()), -1, -1):
            order = by_hash[levels[by_hash] >= level]
            if level and len(order) == len(before):
                continue
            order = np.concatenate([before, order[~np.isin(order, before)]])  # those above come first
            layer = _Layer(lifted, np.sort(order), 2 * degree if level == 0 else degree)
            seeds = order[:_SEEDS]
            if len(seeds) > 1:
                sims = lifted[seeds] @ lifted[seeds].T
                np.fill_diagonal(sims, -np.inf)
                k = min(candidates, len(seeds) - 1)
                layer.link(seeds, seeds[np.argsort(-sims, axis=1, kind="stable")[:, :k]])
            at = len(seeds)
            while at < len(order):
                batch = order[at : at + min(_BATCH, max(64, at // 4), max(16, MARKS // len(lifted)))]
                q = lifted[batch]
                entry = np.repeat(seeds[:_EXPAND][None], len(batch), axis=0)
                if above and at >= len(before):
                    entry = graph._descend(lifted, q, above, max(_EXPAND, candidates // 8))
                found = _walk(lifted, q, entry, layer.row_of, layer.near, candidates)
                sims = q @ q.T
                np.fill_diagonal(sims, -np.inf)
                k = min(candidates // 4, len(batch) - 1)
                if k > 0:
                    found = np.concatenate([found, batch[np.argpartition(-sims, k - 1, axis=1)[:, :k]]], axis=1)
                for i in range(0, len(batch), 256):
                    layer.link(batch[i : i + 256], found[i : i + 256])
                at += len(batch)
            above.append((layer.members.astype(np.int32), layer.finished()))
            before = order
        graph.members, graph.neighbours = [m for m, _ in reversed(above)], [n for _, n in reversed(above)]
        return graph

    @staticmethod
    def _descend(lifted: np.ndarray, q: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]], beam: int) -> np.ndarray:
        """The nearest points of the last of these layers, by a walk through each from the top."""
        entry = np.repeat(layers[0][0][:_EXPAND][None], len(q), axis=0)
        for members, near in layers:
            row_of = np.full(len(lifted), -1, np.int64)
            row_of[members] = np.arange(len(members))
            entry = _walk(lifted, q, entry, row_of, near, beam)
        return entry

    def to_bytes(self) -> bytes:
        n, d = self.vectors.shape
        narrow = self.vectors.astype("<f4")
        exact = (narrow.astype(np.float64) == self.vectors).all()
        parts = [struct.pack("<QQIII", n, len(self.ids), d, len(self.members), int(exact)), self.ids.astype("<i8").tobytes(), self.counts.astype("<i4").tobytes(), (narrow if exact else self.vectors.astype("<f8")).tobytes()]
        for inside, near in zip(self.members, self.neighbours):
            parts += [struct.pack("<QI", *near.shape), inside.astype("<i4").tobytes(), near.astype("<i4").tobytes()]
        return b"".join(parts)

    @classmethod
    def from_bytes(cls, data: bytes) -> Graph:
        n, n_ids, d, layers, exact = struct.unpack_from("<QQIII", data)
        at = struct.calcsize("<QQIII")

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(data, kind, count, at)
            at += got.nbytes
            return got

        ids, counts, vectors = take("<i8", n_ids), take("<i4", n), take("<f4" if exact else "<f8", n * d).reshape(n, d)
        members, neighbours = [], []
        for _ in range(layers):
            rows, degree = struct.unpack_from("<QI", data, at)
            at += 12
            members.append(take("<i4", rows))
            neighbours.append(take("<i4", rows * degree).reshape(rows, degree))
        return cls(ids, counts, vectors, members, neighbours)

    def search(self, queries: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """(queries, beam) places of the best points found, -1 where fewer were."""
        lifted = self.lifted()
        q = queries.astype(np.float64)
        q = np.concatenate([q / np.abs(q).max(axis=1, keepdims=True), np.zeros((len(q), 1))], axis=1).astype(np.float32)
        layers = list(zip(reversed(self.members), reversed(self.neighbours)))
        entry = self._descend(lifted, q, layers[:-1], max(_EXPAND, beam // 8)) if len(layers) > 1 else np.repeat(self.members[0][:_EXPAND][None], len(q), axis=0)
        row_of = np.full(len(lifted), -1, np.int64)
        row_of[self.members[0]] = np.arange(len(self.members[0]))
        return _walk(lifted, q, entry, row_of, self.neighbours[0], beam)

    def lifted(self) -> np.ndarray:
        if not hasattr(self, "_lifted"):
            self._lifted = _lifted(self.vectors)
        return self._lifted


def top(graph: Graph, query_ids: np.ndarray, queries: np.ndarray, k: int = K, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, vector id, score) of the k best each query's walk found, without the query's own id."""
    found = graph.search(queries, max(beam, 2 * k))
    scores = np.einsum("qkd,qd->qk", graph.vectors[np.maximum(found, 0)].astype(np.float64), queries.astype(np.float64))
    # Every point has an id, so the k + 1 best and those that tie with the last hold the answer.
    rank = np.where(found < 0, -np.inf, scores)
    last = -np.sort(-rank, axis=1)[:, min(k, rank.shape[1] - 1), None]
    row, col = np.nonzero((found >= 0) & (rank >= last))
    place = found[row, col]
    n = graph.counts[place].astype(np.int64)
    ends = np.cumsum(graph.counts, dtype=np.int64)
    at = np.repeat((ends - graph.counts)[place] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    q, ids, score = np.repeat(row, n), graph.ids[at], np.repeat(scores[row, col], n)
    other = ids != query_ids[q]
    q, ids, score = q[other], ids[other], score[other]
    order = np.lexsort((ids, -score, q))
    q, ids, score = q[order], ids[order], score[order]
    starts = np.searchsorted(q, np.arange(len(queries)))
    kept = np.arange(len(q)) - starts[q] < k
    return query_ids[q[kept]], ids[kept], score[kept]


def valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding array<double>, dim) of the rows that take part; equal rows once. -0 is 0."""
    rows = picked(vectors, "vec_id", "embedding").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where("vec_id IS NOT NULL AND size(embedding) > 0 AND NOT exists(embedding, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity')) AND exists(embedding, x -> x <> 0)")
    return rows.select("vec_id", F.transform("embedding", lambda x: x + F.lit(0.0)).alias("embedding"), F.size("embedding").alias("dim"))


def points(vectors: DataFrame, k: int = K) -> DataFrame:
    """(dim, embedding, ids): every different vector with its k + 1 least ids.

    The limit of ranks reaches below the shuffle, so a vector that a third of the rows share sends
    few of them, and no group grows with its copies."""
    ranked = valid(vectors).distinct().withColumn("_n", F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))).where(F.col("_n") <= k + 1)
    return ranked.groupBy("dim", "embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    arrays = column.combine_chunks()
    return arrays.flatten().to_numpy(zero_copy_only=False).reshape(len(arrays), -1)


def build(vectors: DataFrame, shard: int | None = None, degree: int = DEGREE, candidates: int = CANDIDATES, k: int = K) -> DataFrame:
    """The index: (dim, shard, graph binary), one row for each shard, in the shared folder; it serves searches for up to ``k``."""
    prepare(vectors.sparkSession)
    held = stored(points(vectors, k), "points")
    n = held.count()
    size = shard or min(GREATEST, max(SHARD, n // SHARDS))
    shards = max(1, -(-n // size))

    def graph(key: Sequence, group: pa.Table) -> pa.Table:
        ids = group.column("ids").combine_chunks()
        counts, flat = np.diff(ids.offsets.to_numpy()).astype(np.int64), ids.flatten().to_numpy()
        order = np.argsort(flat[np.cumsum(counts) - counts], kind="stable")
        starts = (np.cumsum(counts) - counts)[order]
        n = counts[order]
        flat = flat[np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        data = Graph.build(flat, n, _matrix(group.column("embedding"))[order], degree, candidates).to_bytes()
        return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "shard": pa.array([key[1].as_py()], pa.int64()), "graph": pa.array([data], pa.binary())})

    dealt = held.withColumn("shard", F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(shards)))
    return stored(dealt.groupBy("dim", "shard").applyInArrow(graph, "dim int, shard long, graph binary"), "hnsw")


def search(index: DataFrame, queries: DataFrame, k: int = K, beam: int = BEAM, group: int = GROUP) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query row (vec_id, embedding).

    A task holds a graph and one group of queries; its walks mark ``MARKS`` bytes at most."""
    prepare(index.sparkSession)
    rows = stored(valid(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumn("dim", F.size("embedding")), "queries")
    groups = max(1, -(-rows.count() // group))
    dealt = rows.withColumn("group", F.pmod(F.xxhash64(F.lit(7), "vec_id"), F.lit(groups)))
    shards = index.agg(F.max("shard")).first()[0] or 0
    against = dealt.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards).cast("long"))))  # every query against every shard
    graphs = index.withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))

    def find(key: Sequence, graph: pa.Table, asked: pa.Table) -> pa.Table:
        out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        if graph.num_rows and asked.num_rows:
            shard = Graph.from_bytes(graph.column("graph")[0].as_py())
            ids, matrix = asked.column("vec_id").to_numpy(), _matrix(asked.column("embedding"))
            block = min(512, max(8, MARKS // len(shard.vectors)))
            for i in range(0, len(ids), block):
                out.append(top(shard, ids[i : i + block], matrix[i : i + block], k, beam))
        q, v, s = map(np.concatenate, zip(*out))
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(v, pa.int64()), "score": pa.array(s, pa.float64())})

    keys = ["dim", "shard", "group"]
    found = graphs.groupBy(*keys).cogroup(against.groupBy(*keys)).applyInArrow(find, "query_id long, vec_id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, **options) -> DataFrame:
    """Build the index over ``vectors`` and search it for ``queries``."""
    return search(build(vectors, k=k, **options), queries, k)

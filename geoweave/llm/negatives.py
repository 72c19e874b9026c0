"""Hard negatives by product quantisation with stored residual norms.

Vectors are scaled to integers and cut into subspaces; each part is replaced by the nearest of a
few integer centroids, and the norm of what is left is stored with the code. For an anchor, a
table of the products of its parts with all centroids gives the score of any code by lookups. The
true score differs from it by at most the sum over the subspaces of the norm of the anchor's part times the
stored norm, so every row has an interval that surely holds its score. Intervals tell which
rows can be among the first positives or in a window of negatives; only these are scored with
the integers themselves. No row that could be in the result is passed over, however coarse the codes.

Rows are packed in blocks and anchors in groups of bounded bytes. Every group meets every block once, in a
task of its own, first for positives, then for negatives; what a block finds best is merged by a window.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoweave.llm.common import picked, prepare, stored

#: An anchor is a row whose id is divisible by this.
EVERY = 50
SCALE = 256
POSITIVES = 5
NEGATIVES = 3
#: Rows that the codebook is fitted on, at most; chosen by a hash of their ids. All rows are coded.
SAMPLE = 4096
SUBSPACES = 16
CENTROIDS = 64
ITERATIONS = 8
#: Rows in a block and anchors in a group, and the bytes that either may have.
BLOCK_ROWS = 4096
GROUP_ROWS = 4096
BLOCK_BYTES = 1 << 24
#: Anchor by row pairs that a task holds at once.
PAIRS = 1 << 20
#: Pairs that are scored exactly at once.
EXACT = 1 << 17

_PACK = "block int, n int, ids binary, nodes binary, labels binary, vectors binary, codes binary, norms binary"
_POSITIVE = "anchor_node long, anchor_id long, node long, id long, score long"
_NEGATIVE = "anchor_node long, anchor_id long, positive_node long, positive_id long, positive_score long, node long, id long, score long"


def fit(sample: np.ndarray, subspaces: int = SUBSPACES, centroids: int = CENTROIDS) -> np.ndarray:
    """Integer centroids (subspace, centroid, dimension) of a sample of padded integer vectors, by k-means from evenly spaced start rows."""
    width = sample.shape[1] // subspaces
    book = np.zeros((subspaces, centroids, width), np.int64)
    for m in range(subspaces):
        part = sample[:, m * width : (m + 1) * width].astype(np.float64)
        distinct = np.unique(part, axis=0)
        if not len(distinct):
            continue
        mean = distinct[np.linspace(0, len(distinct) - 1, centroids).astype(int)]
        for _ in range(ITERATIONS):
            nearest = _nearest(part, mean)
            size = np.bincount(nearest, minlength=centroids)
            sums = np.stack([np.bincount(nearest, part[:, i], centroids) for i in range(width)], axis=1)
            mean = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], mean)
        book[m] = np.rint(mean)
    return book


def _nearest(part: np.ndarray, mean: np.ndarray) -> np.ndarray:
    out = np.empty(len(part), np.int64)
    for i in range(0, len(part), 1 << 14):
        x = part[i : i + (1 << 14)]
        out[i : i + len(x)] = ((mean * mean).sum(axis=1) - 2 * (x @ mean.T)).argmin(axis=1)
    return out


def encode(vectors: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and, for each subspace, a number not below the norm of the residual. Which centroid is near is a matter of speed alone."""
    subspaces, _, width = book.shape
    codes, norms = np.empty((len(vectors), subspaces), np.uint8), np.empty((len(vectors), subspaces))
    for m in range(subspaces):
        part = vectors[:, m * width : (m + 1) * width]
        codes[:, m] = _nearest(part.astype(np.float64), book[m].astype(np.float64))
        left = (part - book[m][codes[:, m]]).astype(np.float64)
        norms[:, m] = np.sqrt((left * left).sum(axis=1)) * (1 + 1e-9)
    return codes, norms


def greatest(dims: int) -> int:
    """Components up to this size have scores that fit 64 bits."""
    return int(((1 << 62) // max(dims, 1)) ** 0.5)


def _padded(dims: int) -> int:
    return max(1, -(-dims // SUBSPACES)) * SUBSPACES


def _pack_rows(batches: Iterable[pa.RecordBatch], dims: int, book: np.ndarray, rows: int) -> Iterator[pa.RecordBatch]:
    """One row for each lot of at most ``rows`` rows of a block, the rows sorted by block; what a block has comes in several rows where it is larger."""
    schema = pa.schema([("block", pa.int32()), ("n", pa.int32()), *((c, pa.binary()) for c in ("ids", "nodes", "labels", "vectors", "codes", "norms"))])
    held: list[pa.RecordBatch] = []

    def out(block: int) -> pa.RecordBatch:
        lot = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        n = lot.num_rows
        vectors = np.zeros((n, _padded(dims)), np.int64)
        vectors[:, :dims] = lot["v"].chunk(0).values.to_numpy()[: n * dims].reshape(n, dims)
        codes, norms = encode(vectors, book)
        one = [lot[c].to_numpy().astype(np.int64).tobytes() for c in ("id", "node", "label")]
        small = vectors.astype(np.int16) if np.abs(vectors).max(initial=0) < 1 << 15 else vectors
        values = [block, n, *one, small.tobytes(), codes.tobytes(), norms.tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(values, schema)], schema=schema)

    now, size = None, 0
    for batch in batches:
        blocks, at = batch.column(0).to_numpy(), 0
        while at < len(blocks):
            end = int(np.searchsorted(blocks, blocks[at], "right"))
            if held and (now != blocks[at] or size == rows):
                yield out(now)
                size = 0
            now, end = int(blocks[at]), min(end, at + rows - size)
            held.append(pa.RecordBatch.from_arrays([_compact(c) for c in batch.slice(at, end - at).columns], schema=batch.schema))
            size, at = size + end - at, end
    if held:
        yield out(now)


def _compact(column: pa.Array) -> pa.Array:
    """The same values without what a slice leaves out: the values of a list are read as they lie."""
    return pa.concat_arrays([column]) if not pa.types.is_list(column.type) else pa.ListArray.from_arrays(
        pa.array(np.asarray(column.offsets) - column.offsets[0].as_py(), pa.int32()), column.flatten()
    )


class _Pack:
    """The rows of a block or the anchors of a group, as arrays."""

    def __init__(self, n: int, width: int, *parts: pa.Scalar) -> None:
        ids, nodes, labels, vectors, codes, norms = (memoryview(x.as_buffer()) for x in parts)
        self.ids, self.nodes, self.labels = (np.frombuffer(x, np.int64) for x in (ids, nodes, labels))
        kind = np.int16 if len(vectors) == 2 * n * width else np.int64
        self.vectors = np.frombuffer(vectors, kind).reshape(n, width)
        self.codes = np.frombuffer(codes, np.uint8).reshape(n, SUBSPACES)
        self.norms = np.frombuffer(norms, np.float64).reshape(n, SUBSPACES)


def _intervals(anchors: np.ndarray, rows: _Pack, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper ends of the scores of anchors (rows of the result) with rows (columns).

    The lookups are sums of integers; in doubles they round by less than what is added to the bound."""
    subspaces, _, width = book.shape
    score = np.zeros((len(anchors), len(rows.ids)))
    own = np.empty((len(anchors), subspaces))
    for m in range(subspaces):
        part = anchors[:, m * width : (m + 1) * width].astype(np.float64)
        own[:, m] = np.sqrt((part * part).sum(axis=1))
        score += (part @ book[m].T.astype(np.float64))[:, rows.codes[:, m]]
    bound = (own @ rows.norms.T) * (1 + 1e-9) + 1 + np.abs(score) * 1e-9
    return score - bound, score + bound


def _exact(anchors: np.ndarray, vectors: np.ndarray, a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Integer scores of pairs of an anchor and a row."""
    out = np.empty(len(a), np.int64)
    for i in range(0, len(a), EXACT):
        out[i : i + EXACT] = np.einsum("ij,ij->i", anchors[a[i : i + EXACT]].astype(np.int64), vectors[r[i : i + EXACT]].astype(np.int64))
    return out


def _first(group: np.ndarray, score: np.ndarray, ids: np.ndarray, nodes: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k of each group: greatest scores, then least ids, then rows."""
    order = np.lexsort((nodes, ids, -score, group))
    starts = np.flatnonzero(np.r_[True, group[order][1:] != group[order][:-1]]) if len(order) else np.empty(0, np.int64)
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
    return order[rank < k]


def _greatest_of(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th greatest of each row; minus infinity where there are fewer."""
    return np.partition(values, values.shape[1] - k, axis=1)[:, values.shape[1] - k] if values.shape[1] >= k else np.full(len(values), -np.inf)


def _positives(anchors: _Pack, rows: _Pack, book: np.ndarray) -> Iterator[list[np.ndarray]]:
    """Per anchor the first rows of its label in the block."""
    step = max(1, PAIRS // max(1, len(rows.ids)))
    for i in range(0, len(anchors.ids), step):
        cut = slice(i, i + step)
        may = (anchors.labels[cut, None] == rows.labels) & (anchors.nodes[cut, None] != rows.nodes)
        low, high = _intervals(anchors.vectors[cut], rows, book)
        least = _greatest_of(np.where(may, low, -np.inf), POSITIVES)
        a, r = np.nonzero(may & (high >= least[:, None]))
        score = _exact(anchors.vectors[cut], rows.vectors, a, r)
        top = _first(a, score, rows.ids[r], rows.nodes[r], POSITIVES)
        a, r = a[top] + i, r[top]
        yield [anchors.nodes[a], anchors.ids[a], rows.nodes[r], rows.ids[r], score[top]]


def window(score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest negative score of a positive score P: 50 P <= 100 s <= 95 P."""
    return -(-score // 2), 19 * (score // 20) + 19 * (score % 20) // 20


def _negatives(anchors: _Pack, rows: _Pack, book: np.ndarray, found: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """Per anchor and positive the first rows of other labels in the block whose score is in the positive's window.

    ``found`` holds, for the positives of this group, the anchor's node, the positive's node and id, and the score."""
    order = np.argsort(anchors.nodes, kind="stable")
    place = order[np.searchsorted(anchors.nodes, found[0], sorter=order)]
    by = np.argsort(place, kind="stable")
    found, place = [x[by] for x in found], place[by]
    low_end, high_end = window(found[3])
    step = max(1, PAIRS // max(1, len(rows.ids)))
    starts = np.searchsorted(place, np.arange(0, len(anchors.ids) + step, step))
    for i, (lo, hi) in enumerate(zip(starts, starts[1:])):
        if lo == hi:
            continue
        cut = slice(i * step, (i + 1) * step)
        low, high = _intervals(anchors.vectors[cut], rows, book)
        other = anchors.labels[cut, None] != rows.labels
        pairs, wanted, got_a, got_r = place[lo:hi] - i * step, np.zeros(low.shape, bool), [], []
        # The anchors' first positives together, then their second ones, and so on: each anchor once in a pass.
        turn = np.arange(hi - lo) - np.searchsorted(pairs, pairs)
        for t in range(int(turn.max()) + 1):
            one = np.flatnonzero(turn == t)
            a, l, h = pairs[one], low_end[lo:hi][one, None], high_end[lo:hi][one, None]  # noqa: E741
            lo_a, hi_a = low[a], high[a]
            may = other[a] & (hi_a >= l) & (lo_a <= h)
            least = _greatest_of(np.where(may & (lo_a >= l) & (hi_a <= h), lo_a, -np.inf), NEGATIVES)
            may &= hi_a >= least[:, None]
            wanted[a] |= may
            k, r = np.nonzero(may)
            got_a.append(one[k])
            got_r.append(r)
        # A pair that several windows want is scored once.
        a, r = np.nonzero(wanted)
        score = np.zeros(low.shape, np.int64)
        score[a, r] = _exact(anchors.vectors[cut], rows.vectors, a, r)
        p, r = np.concatenate(got_a), np.concatenate(got_r)
        s = score[pairs[p], r]
        inside = (s >= low_end[lo:hi][p]) & (s <= high_end[lo:hi][p])
        p, r, s = p[inside], r[inside], s[inside]
        top = _first(p, s, rows.ids[r], rows.nodes[r], NEGATIVES)
        p, r, s = p[top] + lo, r[top], s[top]
        yield [found[0][p], anchors.ids[place[p]], found[1][p], found[2][p], found[3][p], rows.nodes[r], rows.ids[r], s]


def _met(blocks: DataFrame, groups: DataFrame, n_blocks: int, n_groups: int) -> DataFrame:
    """Every block beside every group, one row for each, dealt over as many tasks as there are pairs, up to the bytes that a task should read."""
    left = blocks.select(F.col("block"), *(F.col(c).alias(f"r_{c}") for c in blocks.columns[1:]), F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))).alias("group"))
    right = groups.select(F.col("block").alias("group"), *(F.col(c).alias(f"a_{c}") for c in groups.columns[1:]), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"))
    parts = max(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_blocks * n_groups // 4)
    return left.repartition(parts, "block", "group").join(right.repartition(parts, "block", "group").hint("merge"), ["block", "group"])


_PARTS = ("n", "ids", "nodes", "labels", "vectors", "codes", "norms")


def _searched(met: DataFrame, dims: int, book: np.ndarray, schema: str, negatives: bool) -> DataFrame:
    width, out = _padded(dims), met.sparkSession.createDataFrame([], schema).schema
    sides = [[f"{s}_{c}" for c in _PARTS] for s in "ra"]
    columns = [*sides[0], *sides[1], *(("found",) if negatives else ())]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = [c[k] for c in batch.columns]
                rows, anchors = (_Pack(part[0].as_py(), width, *part[1:]) for part in (row[:7], row[7:14]))
                if negatives:
                    if row[14].as_py() is None:
                        continue
                    values = row[14].values
                    found = [values.field(i).to_numpy() for i in range(4)]
                    results = _negatives(anchors, rows, book, found)
                else:
                    results = _positives(anchors, rows, book)
                for got in results:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in got], names=out.names)

    return met.select(*columns).mapInArrow(run, out)


def scaled(vectors: DataFrame, id_: str, vector: str, label: str) -> DataFrame:
    """(node, id, label, v, dims) of the rows that take part, written; ``node`` tells rows of one id apart."""
    rows = picked(vectors, id_, vector, label).toDF("id", "v", "label").select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"), F.col("label").cast("long").alias("label"))
    limit = F.sqrt(F.lit(float(1 << 62)) / F.greatest(F.size("v"), F.lit(1)))
    fit = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) * SCALE < limit - 1))
    kept = rows.where("id is not null and v is not null and label is not null").where(fit)
    label = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = F.transform("v", lambda x: F.floor(x * SCALE).cast("long"))
    return stored(kept.select(F.monotonically_increasing_id().alias("node"), "id", label.alias("label"), whole.alias("v"), F.size("v").alias("dims")), "negatives-rows")


def _packed(rows: DataFrame, dims: int, book: np.ndarray, n: int, most: int, name: str) -> tuple[DataFrame, int]:
    """``n`` rows in blocks of at most ``most`` rows, each one row of a written table, numbered from 0."""
    most = max(1, min(most, BLOCK_BYTES // (16 * _padded(dims))))
    cells = max(1, -(-n // most))
    dealt = rows.select(F.pmod(F.xxhash64("node"), F.lit(cells)).cast("int").alias("block"), "id", "node", "label", "v")
    sorted_ = dealt.repartition(max(1, min(cells, 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))), "block").sortWithinPartitions("block", "node")
    packs = stored(sorted_.mapInArrow(lambda batches: _pack_rows(batches, dims, book, most), _PACK), name)
    # Hashing deals unevenly, so some blocks have two rows: number them by block and first node. The numbers sort a table of one row a block.
    numbers = packs.select("block", F.xxhash64("nodes").alias("key")).withColumn("number", F.row_number().over(Window.orderBy("block", "key")) - 1)
    named = packs.withColumn("key", F.xxhash64("nodes")).join(numbers, ["block", "key"])
    return stored(named.select(F.col("number").alias("block"), *packs.columns[1:]), name), packs.count()


def _one_width(rows: DataFrame, dims: int, n: int, every: int) -> DataFrame:
    """The negatives among the rows of one number of components."""
    anchors = rows.where(F.col("id") % every == 0)
    sample = rows.orderBy(F.xxhash64("id", "node")).limit(SAMPLE).select("v").toArrow()["v"].combine_chunks()
    drawn = np.zeros((len(sample), _padded(dims)), np.int64)
    drawn[:, :dims] = np.asarray(sample.flatten()).reshape(len(sample), dims)
    book = fit(drawn)
    blocks, n_blocks = _packed(rows, dims, book, n, BLOCK_ROWS, "negatives-blocks")
    groups, n_groups = _packed(anchors, dims, book, anchors.count(), GROUP_ROWS, "negatives-groups")
    if not n_groups:
        return rows.sparkSession.createDataFrame([], _NEGATIVE)
    met = _met(blocks, groups, n_blocks, n_groups)
    best = Window.partitionBy("anchor_node").orderBy(F.desc("score"), "id", "node")
    found = _searched(met, dims, book, _POSITIVE, False).withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= POSITIVES)
    held = stored(found.drop("_rank"), "negatives-positives")
    # Back to their groups: which group an anchor is in is read from the packed nodes.
    of = groups.select(F.col("block").alias("group"), "nodes").mapInArrow(_unpacked, "group int, anchor_node long")
    positives = held.join(of, "anchor_node").groupBy("group").agg(F.collect_list(F.struct(F.col("anchor_node").alias("anchor"), F.col("node").alias("positive"), F.col("id").alias("positive_id"), F.col("score").alias("score"))).alias("found"))
    with_found = stored(groups.join(positives.withColumnRenamed("group", "block"), "block"), "negatives-windows")
    met = _met(blocks, with_found, n_blocks, n_groups).withColumnRenamed("a_found", "found")
    return _searched(met, dims, book, _NEGATIVE, True)


def _unpacked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for group, nodes in zip(batch.column(0).to_pylist(), batch.column(1)):
            own = np.frombuffer(nodes.as_buffer(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), group, np.int32)), pa.array(own)], names=["group", "anchor_node"])


def hard_negatives(vectors: DataFrame, *, id_: str = "vec_id", vector: str = "embedding", label: str = "label", every: int = EVERY) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor (a row whose id
    is divisible by ``every``) and each of its first 5 other rows of the same label, the first 3 rows of other labels
    that score from 0.5 to 0.95 times as much. Scores are inner products of floor(256 x), greatest first, ties by id.

    Rows with a null id, label, vector or component, or a component that isn't finite, take no part, nor do rows with
    components so large that scores would not fit 64 bits (over 10^6 with 64 components). Vectors of different
    lengths don't meet. Labels of ids divisible by 7 are first moved on by one. Repeated rows are rows of their own: each is
    an anchor and a candidate. An anchor without a positive, or a positive without a negative, has no row; an
    empty table gives none. The score of an empty vector is 0. Other columns are harmless."""
    prepare(vectors.sparkSession)
    rows = scaled(vectors, id_, vector, label)
    widths = sorted((r.dims, r.n) for r in rows.groupBy("dims").agg(F.count("*").alias("n")).collect())
    out = None
    for dims, n in widths:
        one = _one_width(rows.where(F.col("dims") == dims), dims, n, every)
        out = one if out is None else out.union(one)
    if out is None:
        out = vectors.sparkSession.createDataFrame([], _NEGATIVE)
    best = Window.partitionBy("anchor_node", "positive_node").orderBy(F.desc("score"), "id", "node")
    ranked = out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= NEGATIVES)
    return ranked.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))

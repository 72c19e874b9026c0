"""Boosted trees for many classes at once: a softmax over shared labels, histograms, and early stopping.

Features are cut into bins once. Rows of equal bins have equal scores, so they are dealt together and packed: a pack
holds its bins and scores once, the keys, folds and labels of its rows, and how many rows of each label every model learns
from in the round at hand. Every level of a round is one pass over bins, scores and these counts: tasks
sum gradients and curvatures by (model, class, node, feature, bin), Spark adds the sums, and the
best split of every node is found by windows over bins. The driver sees one row a node, which is
what the model itself holds. Sums are kept in fixed point, so they are exact and the same
whatever the partitions and packs.

Models of all folds are fitted side by side in the same passes: a row takes part in those that
don't leave out its fold. So a validated fit reads the rows as often as a single one, and
every pack's scores under every model are at hand in a table that each round writes anew.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoweave.sources import catalog

#: Bin of missing values; features have at most so many bins.
MISSING = 255
#: Gradients are multiples of this.
UNIT = 2.0**-24
#: Numbers that a task's histograms may hold before they are sent on after every batch.
HELD = 1 << 23
#: Most rows of a pack.
PACK = 512
#: Rows that are predicted together.
LOT = 1 << 16


@dataclass
class Settings:
    """Growth of a model. ``penalty`` is added to curvatures, ``least`` is the least curvature of a child; rows and columns are drawn by hashes."""

    rounds: int = 800
    depth: int = 8
    rate: float = 0.06
    patience: int = 50
    rows: float = 0.8
    columns: float = 0.8
    penalty: float = 1.0
    least: float = 1.0
    validation: float = 0.1
    seed: int = 42


@dataclass
class Trees:
    """Trees as heaps, one for each model and class: node i has the children 2 i + 1 and 2 i + 2; feature -1 is a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    missing_left: np.ndarray
    value: np.ndarray
    gain: np.ndarray
    cover: np.ndarray

    @staticmethod
    def empty(models: int, classes: int, depth: int) -> Trees:
        shape = (models, classes, 2 ** (depth + 1) - 1)
        return Trees(np.full(shape, -1, np.int32), np.zeros(shape, np.int16), np.zeros(shape, bool), np.zeros(shape), np.zeros(shape), np.zeros(shape))

    def nodes(self, m: int, k: int, bins: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Node of each row after ``depth`` steps, and whether it got that far (and not to a leaf above)."""
        feature, place, values = np.maximum(self.feature[m, k], 0), np.arange(self.feature.shape[2])[:, None], np.arange(256)
        right = np.where(values == MISSING, ~self.missing_left[m, k, :, None], values > self.cut[m, k, :, None])
        after = np.where((self.feature[m, k, :, None] >= 0) & (place < 2**depth - 1), 2 * place + 1 + right, place).ravel()
        flat, base, node = np.ascontiguousarray(bins).ravel(), np.arange(len(bins)) * bins.shape[1], np.zeros(len(bins), np.int64)
        for _ in range(depth):
            node = after[node * 256 + flat[base + feature[node]]]
        return node, node >= 2**depth - 1


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """Uniform numbers in [0, 1) from integers: a finaliser of 64 bits."""
    z = x.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53


def edges_of(df: DataFrame, features: Sequence[str], bins: int = 64) -> list[list[float]]:
    """Upper ends of each feature's bins, by quantiles; the last bin is open. One aggregation."""
    points = [i / bins for i in range(1, bins)]
    row = df.agg(*(F.percentile_approx(F.nanvl(F.col(f).cast("double"), F.lit(None)), points, 10_000).alias(f"q{i}") for i, f in enumerate(features))).first()
    return [sorted({float(x) for x in (row[i] or []) if np.isfinite(x)}) for i in range(len(features))]


def binned(columns: Sequence[np.ndarray], edges: Sequence[Sequence[float]]) -> np.ndarray:
    """Bins (row, feature) of values; what is not a number is missing."""
    out = np.empty((len(columns[0]) if columns else 0, len(edges)), np.uint8)
    for i, (x, e) in enumerate(zip(columns, edges)):
        out[:, i] = np.where(np.isnan(x), MISSING, np.searchsorted(np.asarray(e, float), x, "left"))
    return out


def _matrix(column: pa.Array, n: int, kind: type, shape: tuple[int, ...]) -> np.ndarray:
    """A column of binary values of one length as an array."""
    if not n:
        return np.empty((0, *shape), kind)
    start = np.frombuffer(column.buffers()[1], np.int32)[column.offset]
    size = int(np.prod(shape)) * np.dtype(kind).itemsize
    return np.frombuffer(column.buffers()[2], np.uint8)[start : start + n * size].view(kind).reshape(n, *shape)


def _flat(column: pa.Array, n: int, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The numbers in a column of binary values one after the other, and how many each value has."""
    if not n:
        return np.empty(0, kind), np.empty(0, np.int64)
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1]
    values = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind)
    return values, np.diff(ends) // np.dtype(kind).itemsize


def _binary(values: np.ndarray, ends: np.ndarray | None = None) -> pa.Array:
    """Binary values: the rows of an array, or its parts between ``ends``."""
    values = np.ascontiguousarray(values)
    ends = np.arange(len(values) + 1) if ends is None else ends
    width = values.itemsize * int(np.prod(values.shape[1:]))
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * width).astype(np.int32)), pa.py_buffer(values)])


def _lots(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about ``LOT`` rows, as every tree costs the same for each batch."""
    held: list[pa.RecordBatch] = []
    for batch in chain(batches, [None]):
        if batch is not None:
            held.append(batch)
        if held and (batch is None or sum(b.num_rows for b in held) >= LOT):
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []


def _softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


_ROWS = "key long, fold int, label int, bins binary"
_TABLE = "bins binary, scores binary, counts binary, keys binary, folds binary, labels binary, loss array<double>, judged array<long>"
_SEEN = ("bins", "scores", "counts")
_NAMES = [c.split()[0] for c in _TABLE.split(", ")]
_SUMS = "model int, class int, node int, feature int, bin int, g long, h long"


class _Pass:
    """What a pass over the table needs; travels to the tasks."""

    def __init__(self, held_out: Sequence[int], classes: int, features: int, settings: Settings) -> None:
        self.held_out, self.classes, self.features, self.settings = list(held_out), classes, features, settings

    def read(self, batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        shape = (len(self.held_out), self.classes)
        return tuple(_matrix(batch.column(i), batch.num_rows, kind, s) for i, (kind, s) in enumerate(((np.uint8, (self.features,)), (np.float32, shape), (np.int32, shape))))

    def counts(self, packs: int, pack: np.ndarray, label: np.ndarray, use: np.ndarray) -> np.ndarray:
        """(pack, class): how many of the rows to use have the label."""
        return np.bincount(pack[use] * self.classes + label[use], minlength=packs * self.classes).reshape(packs, self.classes)

    def learnt(self, turn: int, packs: int, pack: np.ndarray, key: np.ndarray, fold: np.ndarray, label: np.ndarray) -> np.ndarray:
        """(pack, model, class): of how many rows of a label each model learns in a round."""
        drawn = _mixed(key, self.settings.seed * 31 + 7919 * (turn + 1)) < self.settings.rows
        return np.stack([self.counts(packs, pack, label, self.learns(m, key, fold)[0] & drawn) for m in range(len(self.held_out))], axis=1).astype(np.int32)

    def packed(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Packs of rows that come in the order of their bins, with zero scores and the counts of the first round."""
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            key, fold, label = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            bins = _matrix(batch.column(3), n, np.uint8, (self.features,))
            new = np.concatenate([[True], (bins[1:] != bins[:-1]).any(axis=1)])
            starts = np.flatnonzero(new)
            new |= (np.arange(n) - starts[np.cumsum(new) - 1]) % PACK == 0
            ends = np.append(np.flatnonzero(new), n)
            packs, pack = len(ends) - 1, np.cumsum(new) - 1
            counts = self.learnt(0, packs, pack, key, fold, label)
            none = [pa.array([None] * packs, pa.list_(k)) for k in (pa.float64(), pa.int64())]
            rows = [_binary(key, ends), _binary(fold.astype(np.int32), ends), _binary(label.astype(np.int32), ends)]
            yield pa.RecordBatch.from_arrays([_binary(bins[ends[:-1]]), _binary(np.zeros(counts.shape, np.float32)), _binary(counts), *rows, *none], names=_NAMES)

    def learns(self, m: int, key: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows that model ``m`` is fitted on, and those on which its early stopping is judged."""
        own = fold != self.held_out[m]
        judged = _mixed(key, self.settings.seed * 1009 + self.held_out[m]) < self.settings.validation
        return own & ~judged, own & judged

    def columns(self, turn: int, m: int, k: int) -> np.ndarray:
        at = np.arange(self.features) + 1_000_003 * (turn + 1000 * (k + 100 * m))
        drawn = np.flatnonzero(_mixed(at, self.settings.seed + 17) < self.settings.columns)
        return drawn if len(drawn) else np.arange(self.features)

    def histograms(self, batches: Iterable[pa.RecordBatch], turn: int, level: int, trees: Trees, bins_at_most: int) -> Iterator[pa.RecordBatch]:
        nodes, first, models = 2**level, 2**level - 1, len(self.held_out)
        shape = (models, self.classes, nodes, self.features, bins_at_most + 1)
        dense = 2 * int(np.prod(shape)) <= HELD
        whole = np.zeros((2, *shape), np.int64) if dense else None
        schema = pa.schema([(n, pa.int32()) for n in ("model", "class", "node", "feature", "bin")] + [("g", pa.int64()), ("h", pa.int64())])

        def rows(g: np.ndarray, h: np.ndarray, at: tuple[np.ndarray, ...]) -> pa.RecordBatch:
            m, k, node, f, b = at
            b = np.where(b == bins_at_most, MISSING, b)
            columns = [*(pa.array(x.astype(np.int32)) for x in (m, k, node + first, f, b)), pa.array(g), pa.array(h)]
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        for batch in batches:
            bins, scores, counts = self.read(batch)
            places = np.where(bins == MISSING, bins_at_most, bins).astype(np.int64)
            for m in range(models):
                total = counts[:, m].sum(axis=1, dtype=np.int64)
                use = np.flatnonzero(total)
                if not len(use):
                    continue
                p = _softmax(scores[use, m].astype(float))
                for k in range(self.classes):
                    node, live = trees.nodes(m, k, bins[use], level)
                    live = np.flatnonzero(live)
                    if not len(live):
                        continue
                    q, n, hit = p[live, k], total[use[live]], counts[use[live], m, k]
                    g = (n - hit) * np.rint(q / UNIT) + hit * np.rint((q - 1) / UNIT)
                    h = n * np.rint(np.maximum(2 * q * (1 - q), 1e-7) / UNIT)
                    base = (node[live] - first) * (bins_at_most + 1)
                    own = whole[:, m, k] if dense else np.zeros((2, nodes, self.features, bins_at_most + 1), np.int64)
                    for f in self.columns(turn, m, k):
                        at = base + places[use[live], f]
                        for i, weights in enumerate((g, h)):
                            own[i, :, f] += np.bincount(at, weights, nodes * (bins_at_most + 1)).astype(np.int64).reshape(nodes, -1)
                    if not dense:
                        at = np.nonzero(own[1])
                        yield rows(own[0][at], own[1][at], (np.full(len(at[0]), m), np.full(len(at[0]), k), *at))
        if dense:
            at = np.nonzero(whole[1])
            yield rows(whole[0][at], whole[1][at], at)

    def scored(self, batches: Iterable[pa.RecordBatch], turn: int, trees: Trees) -> Iterator[pa.RecordBatch]:
        """The packs with the round's trees added to their scores, the loss and number of the rows that judge each model, and the counts of the next round."""
        depth, models = self.settings.depth, len(self.held_out)
        for batch in batches:
            packs = batch.num_rows
            if not packs:
                continue
            bins, scores, _ = self.read(batch)
            (key, size), (fold, _), (label, _) = (_flat(batch.column(3 + i), packs, kind) for i, kind in enumerate((np.int64, np.int32, np.int32)))
            pack = np.repeat(np.arange(packs), size)
            scores, loss, judged = scores.copy(), np.zeros((packs, models)), np.zeros((packs, models), np.int64)
            for m in range(models):
                for k in range(self.classes):
                    scores[:, m, k] += trees.value[m, k][trees.nodes(m, k, bins, depth)[0]].astype(np.float32)
                counts = self.counts(packs, pack, label, self.learns(m, key, fold)[1])
                judged[:, m] = counts.sum(axis=1)
                loss[:, m] = (counts * -np.log(np.maximum(_softmax(scores[:, m].astype(float)), 1e-15))).sum(axis=1)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(packs + 1) * models, pa.int32()), pa.array(x.ravel())) for x in (loss, judged)]
            counts = self.learnt(turn + 1, packs, pack, key, fold, label)
            yield pa.RecordBatch.from_arrays([batch.column(0), _binary(scores), _binary(counts), *batch.columns[3:6], *lists], names=_NAMES)


def best_splits(sums: DataFrame, settings: Settings) -> DataFrame:
    """(model, class, node, g, h, best): totals of every node, and its best split (gain, feature, cut, missing left, gradient and curvature of the left child)
    where one gains. ``sums`` has one row for each (model, class, node, feature, bin)."""
    feature = Window.partitionBy("model", "class", "node", "feature")
    upto = feature.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_missing = F.col("bin") == MISSING
    wide = sums.withColumns({f"{c}_all": F.sum(c).over(feature) for c in "gh"} | {f"{c}_none": F.sum(F.when(is_missing, F.col(c)).otherwise(0)).over(feature) for c in "gh"} | {f"{c}_upto": F.sum(c).over(upto) for c in "gh"})
    real = lambda c: c * UNIT
    merit = lambda g, h: real(g) * real(g) / (real(h) + settings.penalty)

    def split(missing_left: bool):
        gl, hl = (F.col(f"{c}_upto") + (F.col(f"{c}_none") if missing_left else 0) for c in "gh")
        gr, hr = F.col("g_all") - gl, F.col("h_all") - hl
        gain = merit(gl, hl) + merit(gr, hr) - merit(F.col("g_all"), F.col("h_all"))
        good = ~is_missing & (real(hl) >= settings.least) & (real(hr) >= settings.least) & (gain > 1e-9)
        return F.when(good, F.struct(gain.alias("gain"), (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), F.lit(missing_left).alias("missing_left"), gl.alias("g"), hl.alias("h")))

    both = wide.select("model", "class", "node", "g_all", "h_all", F.greatest(split(False), split(True)).alias("s"))
    return both.groupBy("model", "class", "node").agg(F.max("g_all").alias("g"), F.max("h_all").alias("h"), F.max("s").alias("s"))


@dataclass
class Boosted:
    """Fitted models: ``trees`` of every round, of which model m uses the first ``used[m]``; ``losses`` (round, model) of the judging rows."""

    features: list[str]
    edges: list[list[float]]
    classes: list[int]
    held_out: list[int]
    settings: Settings
    trees: list[Trees] = field(default_factory=list)
    losses: list[list[float]] = field(default_factory=list)
    used: list[int] = field(default_factory=list)

    def scores(self, bins: np.ndarray, m: int) -> np.ndarray:
        """Scores (row, class) under a model."""
        out = np.zeros((len(bins), len(self.classes)))
        for t in self.trees[: self.used[m]]:
            for k in range(len(self.classes)):
                out[:, k] += t.value[m, k][t.nodes(m, k, bins, self.settings.depth)[0]]
        return out

    def predicted(self, df: DataFrame, fold: str | None = None, name: str = "predicted") -> DataFrame:
        """Adds the class of the greatest score (ties to the first) and its probability. With ``fold`` each row is judged by the
        model that left its fold out, else by the first model."""
        names, width, schema = df.columns, len(df.columns), ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + f", {name} int, {name}_p double"
        inputs = df.select("*", *(F.col(f).cast("double").alias(f"_x{i}") for i, f in enumerate(self.features)), (F.col(fold).cast("int") if fold else F.lit(self.held_out[0])).alias("_fold"))

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _lots(batches):
                columns = [batch.column(width + i).to_numpy(zero_copy_only=False) for i in range(len(self.features))]
                bins, folds = binned(columns, self.edges), batch.column(width + len(self.features)).to_numpy(zero_copy_only=False)
                cls, p = np.zeros(len(bins), np.int32), np.full(len(bins), np.nan)
                for m, out in enumerate(self.held_out):
                    own = np.flatnonzero(folds == out)
                    if len(own) and self.classes:
                        q = _softmax(self.scores(bins[own], m))
                        best = q.argmax(axis=1)
                        cls[own], p[own] = np.asarray(self.classes)[best], q[np.arange(len(own)), best]
                yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(cls, mask=np.isnan(p)), pa.array(p, from_pandas=True)], names=[*names, name, f"{name}_p"])

        return inputs.mapInArrow(run, schema)

    def importance(self) -> list[tuple[str, float, float]]:
        """(feature, share of gain, cover): mean gain and cover of a feature's splits in each model, added over the models; gains as shares."""
        gain, cover = np.zeros(len(self.features)), np.zeros(len(self.features))
        for m, used in enumerate(self.used):
            trees = self.trees[:used]
            for f in range(len(self.features)):
                at = [t.feature[m] == f for t in trees]
                n = sum(int(x.sum()) for x in at)
                if n:
                    gain[f] += sum(t.gain[m][x].sum() for t, x in zip(trees, at)) / n
                    cover[f] += sum(t.cover[m][x].sum() for t, x in zip(trees, at)) / n
        shares = gain / (gain.sum() + 1e-9)
        return sorted(zip(self.features, shares.tolist(), cover.tolist()), key=lambda x: (-x[1], x[0]))

    def as_trees(self, m: int = 0) -> list:
        """A model's trees with thresholds and a value for each class, for :func:`geoweave.operators.models.tree_attributions`."""
        from geoweave.operators.models import Tree

        out = []
        for t in self.trees[: self.used[m]]:
            for k in range(len(self.classes)):
                feature, n = t.feature[m, k], t.feature.shape[2]
                inner = feature >= 0
                left = [2 * i + 1 if inner[i] else -1 for i in range(n)]
                thresholds = [self.edges[f][c] if f >= 0 else 0.0 for f, c in zip(feature, t.cut[m, k])]
                values = np.zeros((n, len(self.classes)))
                values[:, k] = np.where(inner, 0.0, t.value[m, k])
                out.append(Tree(left, [i + 1 if i > 0 else -1 for i in left], feature.tolist(), thresholds, np.maximum(t.cover[m, k], 1e-12).tolist(), values))
        return out


def prepared(df: DataFrame, features: Sequence[str], label: str, key: str, fold: str | None, edges: list[list[float]], classes: list[int], step: _Pass) -> DataFrame:
    """The table that passes read: packs of the rows whose label is one of ``classes``.

    Rows are dealt by ranges of bins and key, so equal bins meet and a frequent one is shared by several tasks."""
    known = F.array_position(F.array(*map(F.lit, classes)), F.col(label).cast("int")) - 1
    rows = df.where(F.col(label).cast("int").isin(classes)).select(
        F.xxhash64(F.col(key)).alias("key"), (F.col(fold).cast("int") if fold else F.lit(0)).alias("fold"), known.cast("int").alias("label"), *(F.col(f).cast("double").alias(f"_x{i}") for i, f in enumerate(features))
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = binned([batch.column(3 + i).to_numpy(zero_copy_only=False) for i in range(len(edges))], edges)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], _binary(bins)], names=["key", "fold", "label", "bins"])

    return rows.mapInArrow(run, _ROWS).repartitionByRange("bins", "key").sortWithinPartitions("bins").mapInArrow(step.packed, _TABLE)


def fit(df: DataFrame, features: Sequence[str], label: str, key: str, *, fold: str | None = None, held_out: Sequence[int] = (-1,), bins: int = 64, settings: Settings | None = None) -> Boosted:
    """One model for each fold of ``held_out``, fitted on the rows of other folds (-1 leaves out none).

    Labels are integers; all models share the labels that occur anywhere, so a fold may lack some. ``key`` names a row: draws and
    validation rows go by its hash. A model stops when ``patience`` rounds did not lower the loss of its validation rows and keeps the trees
    up to the best one. Null and not-a-number features are missing, and every split sends them to the side that gains more. Rows
    without a label take no part; without rows there are no trees, and every row is predicted as null."""
    s, features = settings or Settings(), list(features)
    if bins > MISSING:
        raise ValueError(f"at most {MISSING} bins")
    classes = sorted(r[0] for r in df.where(F.col(label).isNotNull()).select(F.col(label).cast("int").alias("c")).distinct().collect())
    model = Boosted(features, edges_of(df, features, bins), classes, list(held_out), s)
    models, most = len(model.held_out), max((len(e) + 1 for e in model.edges), default=1)
    model.used, best, waited = [0] * models, [np.inf] * models, [0] * models
    if not classes:
        return model
    step = _Pass(model.held_out, len(classes), len(features), s)
    table = catalog.stored(prepared(df, features, label, key, fold, model.edges, classes, step), "boosting")
    for turn in range(s.rounds):
        trees = Trees.empty(models, len(classes), s.depth)
        for level in range(s.depth):
            sums = table.select(*_SEEN).mapInArrow(lambda batches: step.histograms(batches, turn, level, trees, most), _SUMS)  # noqa: B023  used at once
            sums = sums.groupBy("model", "class", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
            found = best_splits(sums, s).collect()
            grown = 0
            for r in found:
                at = (r.model, r["class"], r.node)
                if level == 0:
                    trees.value[at], trees.cover[at] = -s.rate * r.g * UNIT / (r.h * UNIT + s.penalty), r.h * UNIT
                if r.s is None:
                    continue
                grown += 1
                trees.feature[at], trees.cut[at], trees.missing_left[at], trees.gain[at] = -r.s.f, -r.s.b, r.s.missing_left, r.s.gain
                for child, g, h in ((2 * r.node + 1, r.s.g, r.s.h), (2 * r.node + 2, r.g - r.s.g, r.h - r.s.h)):
                    trees.value[r.model, r["class"], child], trees.cover[r.model, r["class"], child] = -s.rate * g * UNIT / (h * UNIT + s.penalty), h * UNIT
            if not grown:
                break
        after = catalog.stored(table.mapInArrow(lambda batches: step.scored(batches, turn, trees), _TABLE), "boosting")  # noqa: B023  used at once
        catalog.discard(table)
        table = after
        losses = table.agg(*(F.try_divide(F.sum(F.col("loss")[m]), F.sum(F.col("judged")[m])) for m in range(models))).first()
        model.trees.append(trees)
        model.losses.append(list(losses))
        for m, loss in enumerate(losses):
            if loss is None or loss < best[m] - 1e-9:
                best[m], waited[m], model.used[m] = np.inf if loss is None else loss, 0, turn + 1
            else:
                waited[m] += 1
        if all(w >= s.patience for w in waited):
            break
    catalog.discard(table)
    return model

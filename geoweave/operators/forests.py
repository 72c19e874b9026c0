"""Random forests of all folds in the same passes, on counts of equal rows.

Features are cut into bins once. Rows of equal fold, label and bins become one row that holds how many there are and how often
the bootstrap of each tree draws them; a row's draws are Poisson numbers from a hash of its key. So the table that is read again is
bounded by the bins, however many rows there are. A level of all trees of all folds is one pass over it: tasks count by (model,
tree, node, feature, bin, label), and the counts of a node are added up and give its best split by Gini's impurity among the
features drawn for it. The driver sees one row a node. A fold's model counts what other folds hold; trees of the
same number see the same draws in every model. Rows are scored by their counts, too.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce
from itertools import chain
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoweave.operators import evaluate
from geoweave.operators.boosting import _mixed, edges_of
from geoweave.operators.models import Tree
from geoweave.sources import catalog

#: Bits of a hash for one draw, and draws from one hash of 64 bits.
BITS, DRAWS = 12, 5
#: Rows for each task that counts equal ones, and rows that a task looks at together.
TASK_ROWS, LOT = 500_000, 1 << 16
_SPLITS = "model int, tree int, node int, feature int, cut int, gain double, counts array<double>, left array<double>"


def _poisson(u: Column) -> Column:
    """A Poisson number of mean 1 from a uniform number of ``BITS`` bits."""
    ends = np.rint(np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 9)])) * (1 << BITS)).astype(int)
    return reduce(add, ((u >= int(e)).cast("int") for e in ends if e < 1 << BITS))


def cuts(df: DataFrame, features: Sequence[str], bins: int = 32) -> list[list[float]]:
    """Upper ends of each feature's bins: its values, if there are at most ``bins``, or else quantiles; the last bin is open. Nulls count as 0."""
    df = df.na.fill(0.0, list(features))
    row = df.agg(*(F.approx_count_distinct(f, 0.02).alias(f"n{i}") for i, f in enumerate(features))).first()
    few = [i for i in range(len(features)) if row[i] <= bins]
    many = [i for i in range(len(features)) if row[i] > bins]
    out: list[list[float]] = [[] for _ in features]
    if few:
        values = df.agg(*(F.array_sort(F.collect_set(F.col(features[i]).cast("double"))).alias(f"v{i}") for i in few)).first()
        for i, v in zip(few, values):
            out[i] = v[:-1]
    if many:
        for i, edges in zip(many, edges_of(df, [features[i] for i in many], bins)):
            out[i] = edges
    return out


@dataclass
class Packs:
    """Rows of equal fold, label and bins: (fold, label, n, b0.. bins, w0.. draws of each tree), stored."""

    table: DataFrame
    features: list[str]
    edges: list[list[float]]
    labels: int
    trees: int


def binned(df: DataFrame, features: Sequence[str], edges: Sequence[Sequence[float]]) -> DataFrame:
    """Adds b0.. with the number of ends below each feature's value."""
    df = df.na.fill(0.0, list(features)).withColumns({f"_x{i}": F.col(f).cast("double") for i, f in enumerate(features)})
    cut = [i for i, e in enumerate(edges) if len(e)]
    if cut:  # a value that equals an end belongs to the bin below it
        splits = [[-np.inf, *(float(np.nextafter(x, np.inf)) for x in edges[i]), np.inf] for i in cut]
        df = Bucketizer(splitsArray=splits, inputCols=[f"_x{i}" for i in cut], outputCols=[f"_b{i}" for i in cut]).transform(df)
    places = {f"b{i}": F.col(f"_b{i}").cast("int") if i in cut else F.lit(0) for i in range(len(features))}
    return df.withColumns(places).drop(*(f"_{c}{i}" for c in "xb" for i in range(len(features))))


def packed(df: DataFrame, features: Sequence[str], label: str, labels: int, *, fold: str | None = None, trees: int = 20, bins: int = 32, key: Sequence[str] = (), seed: int = 42) -> Packs:
    """The rows as counts. Labels are 0, 1, ... below ``labels``; ``key`` tells rows apart (all columns where it is empty).

    ``df`` is read for the ends of bins and for the counts, so it should be a stored table."""
    edges = cuts(df, features, bins)
    hashes = {f"_h{i}": F.xxhash64(*(key or df.columns), F.lit(seed * 1009 + i)) for i in range(-(-trees // DRAWS))}
    rows = df.withColumns(hashes)
    draw = [_poisson(F.shiftright(F.col(f"_h{t // DRAWS}"), BITS * (t % DRAWS)).bitwiseAND((1 << BITS) - 1)) for t in range(trees)]
    places = [f"b{i}" for i in range(len(features))]
    rows = binned(rows, features, edges).select(F.col(fold).cast("int").alias("fold") if fold else F.lit(-1).alias("fold"), F.col(label).cast("int").alias("label"), *places, *(d.alias(f"w{t}") for t, d in enumerate(draw)))
    by = ["fold", "label", *places]
    dealt = rows.repartition(df.count() // TASK_ROWS + 1, *by)  # by number: adaptive execution would leave one task for each core
    counts = dealt.groupBy(*by).agg(F.count("*").alias("n"), *(F.sum(f"w{t}").alias(f"w{t}") for t in range(trees)))
    return Packs(catalog.stored(counts.select("fold", "label", "n", *places, *(f"w{t}" for t in range(trees))), "packs"), list(features), edges, labels, trees)


def _lots(batches: Iterable[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of about ``LOT`` rows at a time."""
    held: list[pa.RecordBatch] = []
    for batch in chain(batches, [None]):
        if batch is not None:
            held.append(batch)
        if held and (batch is None or sum(b.num_rows for b in held) >= LOT):
            table = pa.Table.from_batches(held)
            held = []
            if table.num_rows:
                yield [c.to_numpy() for c in table.columns]


@dataclass
class Forest:
    """Trees as heaps, one for each model and tree: node i has the children 2 i + 1 and 2 i + 2; feature -1 is a leaf. Model m leaves out the fold ``held_out[m]``."""

    features: list[str]
    edges: list[list[float]]
    labels: int
    held_out: list[int | None]
    feature: np.ndarray
    cut: np.ndarray
    gain: np.ndarray
    counts: np.ndarray
    use: list[int] = field(default_factory=list)

    def nodes(self, m: int, t: int, bins: Sequence[np.ndarray], steps: int, rows: np.ndarray | None = None) -> np.ndarray:
        """Node of each row (or of ``rows``) after so many steps; rows stay at leaves."""
        rows = np.arange(len(bins[0])) if rows is None else rows
        node = np.zeros(len(rows), np.int64)
        for level in range(steps):
            for i in range(2**level - 1, 2 ** (level + 1) - 1):
                if self.feature[m, t, i] >= 0:
                    at = np.flatnonzero(node == i)
                    node[at] = 2 * i + 1 + (bins[self.feature[m, t, i]][rows[at]] > self.cut[m, t, i])
        return node

    @property
    def depth(self) -> int:
        return (self.feature.shape[2] + 1).bit_length() - 2

    def predicted(self, m: int, bins: Sequence[np.ndarray]) -> np.ndarray:
        """The label of the greatest sum of the leaves' shares, ties to the first."""
        votes = np.zeros((len(bins[0]), self.labels))
        for t in range(self.feature.shape[1]):
            c = self.counts[m, t]
            votes += (c / np.maximum(c.sum(axis=1, keepdims=True), 1e-12))[self.nodes(m, t, bins, self.depth)]
        return votes.argmax(axis=1)

    def pruned(self) -> Forest:
        """Nodes whose children are leaves with the same label become leaves."""
        for m, t in np.ndindex(self.feature.shape[:2]):
            f, most = self.feature[m, t], self.counts[m, t].argmax(axis=1)
            for i in range(2**self.depth - 2, -1, -1):
                below = [2 * i + 1, 2 * i + 2]
                if f[i] >= 0 and (f[below] < 0).all() and most[below[0]] == most[below[1]]:
                    f[i] = -1
        return self

    def importance(self) -> list[tuple[str, float]]:
        """Impurity gained by each feature, as shares of each tree, summed over trees and models and normalised."""
        total = np.zeros(len(self.features))
        for m, t in np.ndindex(self.feature.shape[:2]):
            inner = np.flatnonzero(self.feature[m, t] >= 0)
            own = np.bincount(self.feature[m, t, inner], self.gain[m, t, inner] * self.counts[m, t, inner].sum(axis=1), len(total))
            total += own / own.sum() if own.sum() > 0 else 0
        share = total / (total.sum() + 1e-9)
        return sorted(((self.features[i], float(share[i])) for i in self.use), key=lambda x: (-x[1], x[0]))

    def exported(self, m: int = 0) -> list[Tree]:
        """A model's trees with thresholds and shares of labels, for attributions."""
        out = []
        for t in range(self.feature.shape[1]):
            f, order = self.feature[m, t], [0]
            for i in order:
                order.extend([2 * i + 1, 2 * i + 2] if f[i] >= 0 else [])
            place = {i: k for k, i in enumerate(order)}
            ends = [self.edges[f[i]][self.cut[m, t, i]] if f[i] >= 0 else 0.0 for i in order]
            cover = np.maximum(self.counts[m, t, order].sum(axis=1), 1e-12)
            left, right = ([place[2 * i + 1 + k] if f[i] >= 0 else -1 for i in order] for k in (0, 1))
            out.append(Tree(left, right, [int(f[i]) for i in order], ends, cover.tolist(), self.counts[m, t, order] / cover[:, None]))
        return out


def _gini(counts: np.ndarray) -> np.ndarray:
    n = np.maximum(counts.sum(axis=-1), 1e-12)
    return 1 - ((counts / n[..., None]) ** 2).sum(axis=-1)


def _best(counts: np.ndarray, drawn: Sequence[int]) -> tuple[int, int, float, np.ndarray, np.ndarray]:
    """(feature, cut, gain, counts of the node, counts left) of the best split of (feature, bin, label) of the drawn features; feature -1 where none gains."""
    whole = counts[0].sum(axis=0)
    left = np.cumsum(counts, axis=1)[:, :-1]
    right = whole - left
    nl, nr = left.sum(axis=-1), right.sum(axis=-1)
    gain = np.where((nl > 0) & (nr > 0), _gini(whole) - (nl * _gini(left) + nr * _gini(right)) / max(whole.sum(), 1), 0.0)
    k, b = np.unravel_index(gain.argmax(), gain.shape)
    return (int(drawn[k]), int(b), float(gain[k, b]), whole, left[k, b]) if gain[k, b] > 1e-12 else (-1, 0, 0.0, whole, whole * 0)


def fit(packs: Packs, *, held_out: Sequence[int | None] = (None,), depth: int = 5, use: Sequence[str] | None = None, seed: int = 42) -> Forest:
    """A forest for each fold that is left out (None: none), of all features or those to ``use``. A node looks at as many features as the root of their number."""
    n_features, bins, labels, trees = len(packs.features), max(1, *map(len, packs.edges)) + 1, packs.labels, packs.trees
    chosen = [i for i, f in enumerate(packs.features) if use is None or f in use]
    shape = (len(held_out), trees, 2 ** (depth + 1) - 1)
    forest = Forest(packs.features, packs.edges, labels, list(held_out), np.full(shape, -1, np.int32), np.zeros(shape, np.int32), np.zeros(shape), np.zeros((*shape, labels)), chosen)
    share = len(chosen) if trees == 1 else int(np.ceil(np.sqrt(len(chosen))))

    def drawn(m: int, t: int, node: int) -> list[int]:
        salt = _mixed(np.array(chosen) + 1009 * (node + 1_000_003 * (t + 1000 * (m + 1))), seed)
        return [chosen[i] for i in np.sort(np.argsort(salt)[:share])]

    def count(batches: Iterable[pa.RecordBatch], level: int) -> Iterator[pa.RecordBatch]:
        nodes, first = 2**level, 2**level - 1
        looks = np.zeros((len(held_out), trees, n_features, nodes), bool)  # a node's rows are counted by its drawn features only
        for m, t, node in np.ndindex(len(held_out), trees, nodes):
            looks[m, t, drawn(m, t, node + first), node] = True
        whole = np.zeros((len(held_out), trees, n_features, nodes, bins, labels), np.int64)
        for fold, label, _, *rest in _lots(batches):
            places, draws = rest[:n_features], rest[n_features:]
            for t in range(trees):
                some = draws[t] > 0
                for m, out in enumerate(held_out):
                    at = np.flatnonzero(some if out is None else some & (fold != out))
                    node = forest.nodes(m, t, places, level, at) - first
                    if (node < 0).any():  # leaves above
                        live = np.flatnonzero(node >= 0)
                        at, node = at[live], node[live]
                    base, w = node * (bins * labels) + label[at], draws[t][at].astype(float)
                    for f in chosen:
                        own = slice(None) if looks[m, t, f].all() else np.flatnonzero(looks[m, t, f][node]) if looks[m, t, f].any() else None
                        if own is not None:
                            whole[m, t, f] += np.bincount(base[own] + places[f][at[own]] * labels, w[own], nodes * bins * labels).astype(np.int64).reshape(nodes, bins, labels)
        by = whole.transpose(0, 1, 3, 2, 4, 5)
        m, t, node = np.nonzero(by.any(axis=(3, 4, 5)))
        if len(m):
            yield pa.RecordBatch.from_arrays([*(pa.array(x.astype(np.int32)) for x in (m, t, node + first)), pa.array([by[i][drawn(i[0], i[1], i[2] + first)].tobytes() for i in zip(m, t, node)], pa.binary())], names=["model", "tree", "node", "counts"])

    def split(parts: pd.DataFrame) -> pd.DataFrame:
        m, t, node = (int(parts[c].iloc[0]) for c in ("model", "tree", "node"))
        counts = np.zeros(share * bins * labels, np.int64)
        for part in parts["counts"]:
            counts += np.frombuffer(part, np.int64)
        f, cut, gain, all_, left = _best(counts.reshape(share, bins, labels).astype(float), drawn(m, t, node))
        return pd.DataFrame({"model": [m], "tree": [t], "node": [node], "feature": [f], "cut": [cut], "gain": [gain], "counts": [all_.tolist()], "left": [left.tolist()]})

    for level in range(depth):
        parts = packs.table.mapInArrow(lambda batches, level=level: count(batches, level), "model int, tree int, node int, counts binary")
        found = parts.groupBy("model", "tree", "node").applyInPandas(split, _SPLITS).collect()
        for r in found:
            at = (r.model, r.tree, r.node)
            forest.counts[at] = r.counts
            if r.feature >= 0:
                forest.feature[at], forest.cut[at], forest.gain[at] = r.feature, r.cut, r.gain
                forest.counts[r.model, r.tree, 2 * r.node + 1] = r.left
                forest.counts[r.model, r.tree, 2 * r.node + 2] = np.array(r.counts) - np.array(r.left)
        if not any(r.feature >= 0 for r in found):
            break
    return forest.pruned()


def scored(packs: Packs, forest: Forest) -> DataFrame:
    """(fold, label, predicted, n): every row judged by the model that left out its fold, as counts."""
    n_features = len(packs.features)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fold, label, n, *rest in _lots(batches):
            for m, out in enumerate(forest.held_out):
                at = np.flatnonzero(fold == out)
                if not len(at):
                    continue
                found = forest.predicted(m, [p[at] for p in rest[:n_features]])
                pairs = np.bincount(label[at] * np.int64(forest.labels) + found, n[at].astype(float), forest.labels**2).astype(np.int64)
                some = np.flatnonzero(pairs)
                columns = [np.full(len(some), out, np.int32), (some // forest.labels).astype(np.int32), (some % forest.labels).astype(np.int32), pairs[some]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["fold", "label", "predicted", "n"])

    return packs.table.mapInArrow(run, "fold int, label int, predicted int, n long")


def spatial_cv(df: DataFrame, features: Sequence[str], label: str, labels: int, folds: int = 5, trees: int = 10, depth: int = 5, key: Sequence[str] = ()) -> DataFrame:
    """(fold, accuracy, macro_f1, weighted_f1) of each fold, predicted by a forest of the others."""
    packs = packed(df, features, label, labels, fold="fold", trees=trees, key=key)
    return evaluate.classification_scores(scored(packs, fit(packs, held_out=range(folds), depth=depth)), "label", "predicted", labels, "fold", weight="n")


def ablation(df: DataFrame, features: Sequence[str], without: Sequence[str], label: str, labels: int, folds: int, trees: int, depth: int, key: Sequence[str] = ()) -> DataFrame:
    """(features, accuracy, macro_f1, weighted_f1): means of folds with all features, and without those of the named prefixes. Both are fitted on the same counts."""
    packs = packed(df, features, label, labels, fold="fold", trees=trees, key=key)
    fewer = [f for f in features if not any(f.startswith(p) for p in without)]
    out = None
    for name, used in (("all", list(features)), ("without " + ", ".join(without), fewer)):
        pairs = scored(packs, fit(packs, held_out=range(folds), depth=depth, use=used))
        one = evaluate.mean_of_folds(evaluate.classification_scores(pairs, "label", "predicted", labels, "fold", weight="n")).select(F.lit(name).alias("features"), "*")
        out = one if out is None else out.unionAll(one)
    return out

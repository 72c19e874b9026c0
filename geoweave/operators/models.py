"""Models: spatially blocked forests, exact tree attributions, and the spillover test.

Forests are MLlib's, which are multiclass and train on partitions. Attributions follow the
tree-path algorithm for Shapley values, applied to the exported trees in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoweave.operators import causal, evaluate


def assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep").transform(df.na.fill(0.0, list(features)))


def train_forest(df: DataFrame, features: Sequence[str], label: str, trees: int = 20, depth: int = 6, seed: int = 42):
    """A random forest on rows (features, label); labels are 0, 1, ... as numbers."""
    data = assemble(df, features).withColumn("_label", F.col(label).cast("double"))
    return RandomForestClassifier(labelCol="_label", featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed).fit(data)


def train_boosted(df: DataFrame, features: Sequence[str], label: str, rounds: int = 20, depth: int = 5, seed: int = 42):
    """Boosted trees for many classes: one against the rest for each label, as MLlib's boosting knows two classes only."""
    data = assemble(df, features).withColumn("_label", F.col(label).cast("double"))
    one = GBTClassifier(labelCol="_label", featuresCol="features", maxIter=rounds, maxDepth=depth, stepSize=0.1, seed=seed)
    return OneVsRest(classifier=one, labelCol="_label", featuresCol="features", parallelism=2).fit(data)


def folds_predicted(df: DataFrame, features: Sequence[str], label: str, folds: int, train) -> tuple[DataFrame, list]:
    """(out-of-fold predictions (fold, label, predicted), the folds' models): every fold predicted by a model of the others.

    ``df`` is read once for each fold, so it should be a stored table."""
    out, models = None, []
    for fold in range(folds):
        model = train(df.where(F.col("fold") != fold), features, label)
        models.append(model)
        scored = model.transform(assemble(df.where(F.col("fold") == fold), features)).select("fold", label, F.col("prediction").cast("int").alias("predicted"))
        out = scored if out is None else out.unionAll(scored)
    return out, models


def spatial_cv(df: DataFrame, features: Sequence[str], label: str, labels: int, folds: int = 5, trees: int = 10, depth: int = 5) -> DataFrame:
    """(fold, accuracy, macro_f1, weighted_f1) of each fold, predicted by a forest trained on the others."""
    out, _ = folds_predicted(df, features, label, folds, lambda d, f, y: train_forest(d, f, y, trees, depth))
    return evaluate.classification_scores(out, label, "predicted", labels, "fold")


def ablation(df: DataFrame, features: Sequence[str], without: Sequence[str], label: str, labels: int, folds: int, train) -> DataFrame:
    """(features, accuracy, macro_f1, weighted_f1): means of folds with all features, and without those of the named prefixes."""
    fewer = [f for f in features if not any(f.startswith(p) for p in without)]
    out = None
    for name, used in (("all", list(features)), ("without " + ", ".join(without), fewer)):
        scored, _ = folds_predicted(df, used, label, folds, train)
        one = evaluate.mean_of_folds(evaluate.classification_scores(scored, label, "predicted", labels, "fold")).select(F.lit(name).alias("features"), "*")
        out = one if out is None else out.unionAll(one)
    return out


class Tree:
    """A tree as arrays: children, feature, threshold (left if value <= threshold), cover, and values (node, class)."""

    def __init__(self, left: Sequence[int], right: Sequence[int], feature: Sequence[int], threshold: Sequence[float], cover: Sequence[float], values: Sequence[Sequence[float]]):
        self.left, self.right, self.feature = list(left), list(right), list(feature)
        self.threshold, self.cover, self.values = list(threshold), list(cover), np.asarray(values, float)

    def expected(self, node: int = 0) -> np.ndarray:
        if self.left[node] < 0:
            return self.values[node]
        l, r = self.left[node], self.right[node]
        return (self.cover[l] * self.expected(l) + self.cover[r] * self.expected(r)) / self.cover[node]

    def predict(self, x: Sequence[float]) -> np.ndarray:
        node = 0
        while self.left[node] >= 0:
            node = self.left[node] if x[self.feature[node]] <= self.threshold[node] else self.right[node]
        return self.values[node]


def exported_trees(model) -> list[Tree]:
    """The trees of an MLlib forest, with class shares as values, through its public tree nodes."""
    out = []
    for tree in model._java_obj.trees():
        left, right, feature, threshold, cover, values = [], [], [], [], [], []

        def add(node) -> int:
            at = len(left)
            stats = np.array(list(node.impurityStats().stats()))
            left.append(-1), right.append(-1), feature.append(-1), threshold.append(0.0)
            cover.append(max(stats.sum(), 1e-12)), values.append(stats / max(stats.sum(), 1e-12))
            if node.subtreeDepth() > 0:
                split = node.split()
                feature[at], threshold[at] = split.featureIndex(), split.threshold()
                left[at] = add(node.leftChild())
                right[at] = add(node.rightChild())
            return at

        add(tree.rootNode())
        out.append(Tree(left, right, feature, threshold, cover, values))
    return out


def _leaves(tree: Tree) -> list[tuple[int, dict[int, float], list[tuple[int, float, bool]]]]:
    """(leaf, share of coverage that each feature's splits let through, the splits: feature, threshold, left) of every leaf."""
    out, work = [], [(0, {}, [])]
    while work:
        node, shares, splits = work.pop()
        if tree.left[node] < 0:
            out.append((node, shares, splits))
            continue
        f = tree.feature[node]
        for child, left in ((tree.left[node], True), (tree.right[node], False)):
            work.append((child, shares | {f: shares.get(f, 1.0) * tree.cover[child] / tree.cover[node]}, [*splits, (f, tree.threshold[node], left)]))
    return out


def tree_attributions(tree: Tree, x: np.ndarray, n_features: int) -> np.ndarray:
    """Exact Shapley values (row, feature, class) of one tree for rows (row, feature), leaf by leaf and for all rows at once.

    For a leaf, a feature on its path is either unknown, and lets its share of coverage through, or
    known, and lets the row through or not. ``weights[k]`` sums, over the sets of ``k`` known features,
    what comes through, each set by its part of all orders; taking one feature out again gives its value."""
    x = np.atleast_2d(np.asarray(x, float))
    phi = np.zeros((len(x), n_features, tree.values.shape[1]))
    for leaf, shares, splits in _leaves(tree):
        through = {f: np.ones(len(x)) for f in shares}
        for f, threshold, left in splits:
            through[f] *= (x[:, f] <= threshold) == left
        n = len(shares)
        weights = np.zeros((n + 1, len(x)))
        weights[0] = 1.0
        for d, (f, share) in enumerate(shares.items()):
            for k in range(d, -1, -1):
                weights[k + 1] += through[f] * weights[k] * (k + 1) / (d + 2)
                weights[k] *= share * (d + 1 - k) / (d + 2)
        for f, share in shares.items():
            known = through[f] > 0
            after, total = weights[n].copy(), np.zeros(len(x))
            for k in range(n - 1, -1, -1):
                part = after * (n + 1) / (k + 1)
                total += np.where(known, part, weights[k] * (n + 1) / (share * (n - k)))
                after = weights[k] - part * share * (n - k) / (n + 1)
            phi[:, f] += (total * (through[f] - share))[:, None] * tree.values[leaf]
    return phi


def attributions(df: DataFrame, model, features: Sequence[str], key: str) -> DataFrame:
    """(key, feature, class, phi) of every row of a (sampled) table under a forest, or under a list of trees; trees travel with the function."""
    trees, names = model if isinstance(model, list) else exported_trees(model), list(features)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            phi = sum(tree_attributions(t, batch[names].fillna(0.0).to_numpy(float), len(names)) for t in trees) / len(trees)
            n, classes = len(batch), phi.shape[2]
            yield pd.DataFrame({key: np.repeat(batch[key].to_numpy(), len(names) * classes), "feature": np.tile(np.repeat(names, classes), n), "class": np.tile(np.arange(classes), n * len(names)), "phi": phi.reshape(-1)})

    return df.select(key, *names).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, feature string, class int, phi double")


def attribution_summary(phi: DataFrame) -> DataFrame:
    """(feature, class, mean_abs) and the feature's mean over classes as ``overall``."""
    by = phi.groupBy("feature", "class").agg(F.avg(F.abs("phi")).alias("mean_abs"))
    return by.join(by.groupBy("feature").agg(F.avg("mean_abs").alias("overall")), "feature")


def average_rank(df: DataFrame, value: str, name: str = "rank") -> DataFrame:
    """Adds the rank by falling value, ties sharing the mean of their ranks cut to an integer.

    Ranks come from the counts of distinct values, summed in ranges of values."""
    counts = df.groupBy(value).agg(F.count("*").alias("_n"))
    ranked = causal.running_counts(counts, value, "_n", ())
    above = F.col("_all") - F.col("_upto")
    return df.join(ranked.select(value, F.floor(above + (F.col("_n") + 1) / 2).cast("int").alias(name)), value)


def importance(models: Sequence, features: Sequence[str]) -> list[tuple[str, float]]:
    """Feature importances summed over the folds' models and normalised."""
    total = sum(m.featureImportances.toArray() for m in models)
    return sorted(zip(features, (total / (total.sum() + 1e-9)).tolist()), key=lambda t: (-t[1], t[0]))


def spillover(train: DataFrame, test: DataFrame, own: Sequence[str], neighbour: Sequence[str], label: str, threshold: float = 0.01) -> DataFrame:
    """(model, r2) of a regression on own features and on own with neighbours', and the gap; gaps up to ``threshold`` are no spillover."""
    rows = []
    for name, features in (("own", own), ("own_and_neighbours", [*own, *neighbour])):
        model = LinearRegression(featuresCol="features", labelCol=label, solver="normal").fit(assemble(train, features))
        scored = model.transform(assemble(test, features))
        e = F.col(label) - F.col("prediction")
        r2 = scored.agg((1 - F.try_divide(F.avg(e * e), F.var_pop(label))).alias("r2")).first()["r2"]
        rows.append((name, float(r2) if r2 is not None else None))
    gap = None if None in (rows[0][1], rows[1][1]) else rows[1][1] - rows[0][1]
    return train.sparkSession.createDataFrame([*rows, ("gap", gap), ("spillover", float(gap is not None and gap > threshold))], "model string, r2 double")


class Adam:
    """Steps of Adam on named parameters, changed in place, with gradients clipped to a norm."""

    def __init__(self, p: dict[str, np.ndarray], rate: float, clip: float):
        self.p, self.rate, self.clip, self.t = p, rate, clip, 0
        self.m, self.s = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))

    def step(self, g: dict[str, np.ndarray]) -> None:
        self.t += 1
        norm = np.sqrt(sum((v * v).sum() for v in g.values()))
        for k, v in g.items():
            v = v * min(1.0, self.clip / (norm + 1e-12))
            self.m[k] = 0.9 * self.m[k] + 0.1 * v
            self.s[k] = 0.999 * self.s[k] + 0.001 * v * v
            self.p[k] -= self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.s[k] / (1 - 0.999**self.t)) + 1e-8)


def _sigmoid(a: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(-a)), in place."""
    np.clip(a, -40, 40, out=a)
    np.negative(a, out=a)
    np.exp(a, out=a)
    a += 1
    return np.reciprocal(a, out=a)


class RecurrentNode:
    """A gated recurrent unit with a linear head, trained by Adam with clipped gradients; NumPy, for one bounded series table."""

    def __init__(self, inputs: int, hidden: int = 8, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.p = {g: rng.normal(0, 0.3, (inputs + hidden + 1, hidden)) for g in ("z", "r", "h")} | {"o": rng.normal(0, 0.3, (hidden + 1, 1))}
        self.hidden = hidden

    def _unrolled(self, x: np.ndarray) -> tuple[np.ndarray, list]:
        """(states (step, hidden, row), what each step saw and had): rows lie along the last axis, so every operation runs over long lines."""
        (n, steps, k), hidden = x.shape, self.hidden
        seen, gates = np.ascontiguousarray(x.transpose(1, 2, 0)), np.concatenate([self.p["z"], self.p["r"]], axis=1).T
        states, saved, h = np.empty((steps, hidden, n)), [], np.zeros((hidden, n))
        for t in range(steps):
            u = np.concatenate([seen[t], h, np.ones((1, n))])
            v, zr = u, _sigmoid((gates if t else gates[:hidden]) @ u)  # without a state before there is nothing to forget
            if t:
                v = u.copy()
                v[k:-1] *= zr[hidden:]
            c = _sigmoid(2 * (self.p["h"].T @ v))
            c *= 2
            c -= 1  # the hyperbolic tangent, whose own function takes twice the time
            saved.append((u, v, zr, c, h))
            h = states[t] = h + zr[:hidden] * (c - h)
        return states, saved

    def _backwards(self, saved: list, heads: np.ndarray, g: dict[str, np.ndarray]) -> None:
        """Adds the gates' gradients to ``g``; ``heads`` (step, hidden, row) is what the head passes to each state."""
        hidden, k = self.hidden, len(saved[0][0]) - self.hidden - 1
        gates, dh = np.concatenate([self.p["z"], self.p["r"]], axis=1)[k:-1], np.zeros_like(heads[0])
        for t in range(len(saved) - 1, -1, -1):
            u, v, zr, c, h = saved[t]
            z, r = zr[:hidden], zr[hidden:]
            dh = dh + heads[t]
            through = dh * z
            dc = through * (1 - c * c)
            dzr = zr * (1 - zr)
            dzr[:hidden] *= dh * (c - h)
            g["h"] += v @ dc.T
            if not t:
                g["z"] += u @ dzr.T
                break
            drh = self.p["h"][k:-1] @ dc
            dzr[hidden:] *= drh * h
            both = u @ dzr.T
            g["z"] += both[:, :hidden]
            g["r"] += both[:, hidden:]
            dh = dh - through + drh * r + gates @ dzr

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self._unrolled(x)[0][-1].T @ self.p["o"][:-1, 0] + self.p["o"][-1, 0]

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        states, saved = self._unrolled(x)
        out = self.p["o"][:-1, 0] @ states[-1] + self.p["o"][-1, 0]
        error = (out - y) / len(y)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["o"] = np.append(states[-1] @ error, error.sum())[:, None]
        heads = np.zeros_like(states)
        heads[-1] = self.p["o"][:-1] * error
        self._backwards(saved, heads, g)
        return float(((out - y) ** 2).mean() / 2), g

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int = 200, rate: float = 0.02, clip: float = 2.0, patience: int = 40) -> RecurrentNode:
        best, held, waited, adam = np.inf, None, 0, Adam(self.p, rate, clip)
        for _ in range(rounds):
            loss, g = self.gradients(x, y)
            if loss < best - 1e-9:
                best, held, waited = loss, {k: v.copy() for k, v in self.p.items()}, 0
            elif (waited := waited + 1) >= patience:
                break
            adam.step(g)
        if held:
            self.p = held
        return self

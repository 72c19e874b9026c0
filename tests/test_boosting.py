"""Histogram boosting against a plain loop, and how it stops, handles missing values and ranks features."""

import numpy as np
import pytest

from geoweave.operators import boosting, evaluate, models
from geoweave.operators.boosting import MISSING, UNIT, Settings


def rows(n=900, seed=0):
    """Three classes in rings and quadrants, which no single split tells apart; a noise column and missing values."""
    rng = np.random.default_rng(seed)
    x, y, noise = rng.normal(size=n), rng.normal(size=n), rng.normal(size=n)
    label = np.where(x * x + y * y < 0.8, 0, np.where(x * y > 0, 2, 5))
    x = np.where(rng.random(n) < 0.1, np.nan, x)
    return [(i, None if np.isnan(a) else float(a), float(b), float(c), int(k), i % 3) for i, (a, b, c, k) in enumerate(zip(x, y, noise, label))]


SCHEMA = "id long, x double, y double, noise double, label int, fold int"
NAMES = ["x", "y", "noise"]


def plain(bins, label, classes, s, learns):
    """The same model by loops over rows and bins; without drawing rows or columns."""
    scores = np.zeros((len(bins), classes))
    out = []
    for _ in range(s.rounds):
        e = np.exp((scores - scores.max(axis=1, keepdims=True)).astype(np.float64))
        p = e / e.sum(axis=1, keepdims=True)
        turn = []
        for k in range(classes):
            g = np.rint((p[:, k] - (label == k)) / UNIT)
            h = np.rint(np.maximum(2 * p[:, k] * (1 - p[:, k]), 1e-7) / UNIT)
            splits, values, work = {}, {}, [(0, np.flatnonzero(learns))]
            merit = lambda a, b: a * UNIT * a * UNIT / (b * UNIT + s.penalty)
            while work:
                node, at = work.pop()
                gs, hs = g[at].sum(), h[at].sum()
                values[node] = -s.rate * gs * UNIT / (hs * UNIT + s.penalty)
                if node >= 2**s.depth - 1:
                    continue
                best = None
                for f in range(bins.shape[1]):
                    for b in np.unique(bins[at, f]):
                        if b == MISSING:
                            continue
                        for missing_left in (False, True):
                            left = (bins[at, f] <= b) | (missing_left & (bins[at, f] == MISSING))
                            gl, hl = g[at][left].sum(), h[at][left].sum()
                            if min(hl, hs - hl) * UNIT < s.least:
                                continue
                            gain = merit(gl, hl) + merit(gs - gl, hs - hl) - merit(gs, hs)
                            if gain > 1e-9 and (best is None or (gain, -f, -int(b), missing_left) > best[0]):
                                best = ((gain, -f, -int(b), missing_left), left)
                if best:
                    splits[node] = (-best[0][1], -best[0][2], best[0][3])
                    work += [(2 * node + 1, at[best[1]]), (2 * node + 2, at[~best[1]])]
            turn.append((splits, values))
            node = np.zeros(len(bins), int)
            for _ in range(s.depth):
                for i in range(len(bins)):
                    if node[i] in splits:
                        f, b, missing_left = splits[node[i]]
                        left = missing_left if bins[i, f] == MISSING else bins[i, f] <= b
                        node[i] = 2 * node[i] + (1 if left else 2)
            scores[:, k] = (scores[:, k].astype(np.float32) + np.array([values[j] for j in node], np.float32)).astype(np.float32)
        out.append(turn)
    return out


def test_splits_and_values_equal_a_plain_loop(spark):
    data = rows(300)
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    s = Settings(rounds=2, depth=2, rate=0.3, rows=1.0, columns=1.0, validation=0.0)
    got = boosting.fit(df, NAMES, "label", "id", bins=8, settings=s)
    assert got.classes == [0, 2, 5]
    columns = [np.array([np.nan if r[i] is None else r[i] for r in data]) for i in (1, 2, 3)]
    bins = boosting.binned(columns, got.edges)
    want = plain(bins, np.searchsorted(got.classes, [r[4] for r in data]), 3, s, np.ones(len(data), bool))
    for t, turn in zip(got.trees, want):
        for k, (splits, values) in enumerate(turn):
            assert {i: (int(f), int(t.cut[0, k, i]), bool(t.missing_left[0, k, i])) for i, f in enumerate(t.feature[0, k]) if f >= 0} == splits
            assert all(abs(t.value[0, k, i] - v) < 1e-6 for i, v in values.items())


def test_histograms_that_are_not_held_give_the_same_model(spark, monkeypatch):
    df = spark.createDataFrame(rows(300), SCHEMA)
    s = Settings(rounds=1, depth=2, rate=0.3)
    one = boosting.fit(df, NAMES, "label", "id", bins=8, settings=s)
    monkeypatch.setattr(boosting, "HELD", 0)
    two = boosting.fit(df.repartition(5), NAMES, "label", "id", bins=8, settings=s)
    assert (one.trees[0].feature == two.trees[0].feature).all() and np.allclose(one.trees[0].value, two.trees[0].value)


def test_folds_side_by_side_beat_a_forest_and_rank_the_noise_last(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    s = Settings(rounds=12, depth=4, rate=0.3, patience=4)
    model = boosting.fit(df, NAMES, "label", "id", fold="fold", held_out=[0, 1, 2], bins=32, settings=s)
    scored = model.predicted(df, "fold")
    assert scored.columns == [*df.columns, "predicted", "predicted_p"]
    by = {r.fold: r.macro_f1 for r in evaluate.classification_scores(scored, "label", "predicted", 6, "fold").collect()}
    forest, _ = models.folds_predicted(df, NAMES, "label", 3, lambda d, f, y: models.train_forest(d, f, y, 12, 4))
    other = {r.fold: r.macro_f1 for r in evaluate.classification_scores(forest, "label", "predicted", 6, "fold").collect()}
    assert sum(by.values()) >= sum(other.values())
    assert [n for n, _, _ in model.importance()][-1] == "noise"
    # What a model that left a fold out says is what a model fitted on the other folds alone says.
    alone = boosting.fit(df.where("fold <> 1"), NAMES, "label", "id", fold="fold", held_out=[1], bins=32, settings=Settings(rounds=2, depth=4, rate=0.3, patience=4))
    assert len(alone.trees) == 2 and alone.classes == model.classes


def test_noise_labels_stop_early(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, float(rng.normal()), 0.0, float(rng.normal()), int(rng.integers(3)), 0) for i in range(600)], SCHEMA)
    model = boosting.fit(df, NAMES, "label", "id", bins=16, settings=Settings(rounds=12, depth=3, rate=0.8, patience=2, validation=0.3))
    assert len(model.trees) < 12 and model.used[0] <= len(model.trees) - 2


def test_attributions_add_up_to_the_scores(spark):
    data = [r for r in rows(300) if r[1] is not None]
    model = boosting.fit(spark.createDataFrame(data, SCHEMA), NAMES, "label", "id", bins=16, settings=Settings(rounds=2, depth=3, rate=0.5))
    x = np.array([r[1:4] for r in data[:20]])
    trees = model.as_trees()
    phi = sum(models.tree_attributions(t, x, 3) for t in trees)
    base = sum(t.expected() for t in trees)
    scores = model.scores(boosting.binned(list(x.T), model.edges), 0)
    assert np.allclose(base + phi.sum(axis=1), scores, atol=1e-6)


def test_odd_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    empty = boosting.fit(none, NAMES, "label", "id", settings=Settings(rounds=2, depth=2))
    assert empty.trees == [] and empty.predicted(none).count() == 0
    assert [r.predicted for r in empty.predicted(spark.createDataFrame(rows(3), SCHEMA)).collect()] == [None] * 3
    one = spark.createDataFrame([(i, None, None, None, 4, 0) for i in range(20)] + [(99, 1.0, 1.0, 1.0, None, 0)], SCHEMA)
    model = boosting.fit(one, NAMES, "label", "id", settings=Settings(rounds=2, depth=2))
    assert {r.predicted for r in model.predicted(one).collect()} == {4}
    with pytest.raises(ValueError):
        boosting.fit(one, NAMES, "label", "id", bins=300)

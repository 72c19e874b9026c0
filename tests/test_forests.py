"""Forests on counts of equal rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoweave.operators import forests, models
from geoweave.plans import views
from geoweave.plans.queries import QUERIES
from geoweave.sources import catalog


def table(spark, n=3000):
    rng = np.random.default_rng(8)
    x, y, fold = rng.integers(0, 6, n), rng.integers(0, 4, n), rng.integers(0, 3, n)
    label = np.where(rng.random(n) < 0.1, rng.integers(0, 3, n), (x > 2).astype(int) + (y > 1))
    rows = [(i, float(a), float(b), int(c), int(f)) for i, (a, b, c, f) in enumerate(zip(x, y, label, fold))]
    return spark.createDataFrame(rows, "id long, x double, y double, label int, fold int").repartition(3)


def test_a_forest_reads_equal_rows_once(spark):
    df = table(spark)
    packs = forests.packed(df, ["x", "y"], "label", 3, fold="fold", trees=7, key=["id"])
    rows = packs.table.collect()
    assert len(rows) <= 3 * 3 * 6 * 4 < df.count() and sum(r.n for r in rows) == 3000
    want = {(r.fold, r.label, int(r.x), int(r.y)): r["count"] for r in df.groupBy("fold", "label", "x", "y").count().collect()}
    assert {(r.fold, r.label, r.b0, r.b1): r.n for r in rows} == want
    for t in range(7):  # Poisson draws of mean 1, one for each row and tree, whatever the partitions
        assert abs(sum(r[f"w{t}"] for r in rows) - 3000) < 4 * 3000**0.5
    again = forests.packed(df.repartition(5), ["x", "y"], "label", 3, fold="fold", trees=7, key=["id"])
    assert sorted(map(tuple, again.table.collect())) == sorted(map(tuple, rows))
    forest = forests.fit(packs, held_out=range(3), depth=3)
    scores = forests.scored(packs, forest)
    assert scores.agg(F.sum("n")).first()[0] == 3000
    right = scores.where("label = predicted").agg(F.sum("n")).first()[0]
    assert right > 0.88 * 3000


def test_a_level_finds_the_best_splits(spark):
    """Every node's counts and split against plain loops over the drawn rows."""
    df = table(spark, 800)
    packs = forests.packed(df, ["x", "y"], "label", 3, fold="fold", trees=1, key=["id"])
    forest = forests.fit(packs, held_out=[0, None], depth=2)
    rows = packs.table.toPandas()
    for m, out in enumerate([0, None]):
        own = rows[rows.fold != out] if out is not None else rows
        gini = lambda d: 1 - sum((d[d.label == k].w0.sum() / max(d.w0.sum(), 1)) ** 2 for k in range(3))
        splits = {(f, c): (own[own[f"b{f}"] <= c], own[own[f"b{f}"] > c]) for f, b in ((0, 6), (1, 4)) for c in range(b - 1)}
        gains = {k: gini(own) - sum(d.w0.sum() * gini(d) for d in parts) / own.w0.sum() for k, parts in splits.items()}
        best = max(gains, key=gains.get)
        assert (forest.feature[m, 0, 0], forest.cut[m, 0, 0]) == best
        assert forest.gain[m, 0, 0] == pytest.approx(gains[best])
        for side, part in zip((1, 2), splits[best]):
            assert forest.counts[m, 0, side].tolist() == [part[part.label == k].w0.sum() for k in range(3)]


def test_bins_hold_values_up_to_their_ends(spark):
    df = spark.createDataFrame([(float(i), i % 2, None if i == 5 else 1.5) for i in range(100)], "a double, b int, c double")
    edges = forests.cuts(df, ["a", "b", "c"], 8)
    assert len(edges[0]) == 7 and edges[1] == [0.0] and edges[2] == [0.0]
    rows = forests.binned(df, ["a", "b", "c"], edges).select("a", "b0", "b", "b1", "b2").collect()
    assert all(r.b0 == sum(r.a > e for e in edges[0]) and r.b1 == r.b and r.b2 == int(r.a != 5.0) for r in rows)
    none = forests.packed(df.where("a < 0").withColumn("y", F.lit(0)), ["a"], "y", 2, trees=2)
    assert forests.fit(none).feature.max() == -1
    same = forests.packed(df.withColumn("z", F.lit(2)), ["z"], "b", 2, trees=2)
    assert forests.fit(same).feature.max() == -1


def test_exported_trees_are_those_of_the_forest(spark):
    df = table(spark, 900)
    forest = forests.fit(forests.packed(df, ["x", "y"], "label", 3, trees=3, key=["id"]), depth=3)
    trees = forest.exported()
    for x in (0.0, 2.0, 3.0, 5.0):
        for y in (0.0, 1.0, 3.0):
            bins = [np.array([sum(v > e for e in edges)]) for v, edges in zip((x, y), forest.edges)]
            assert int(sum(t.predict((x, y)) for t in trees).argmax()) == forest.predicted(0, bins)[0]
    phi = models.attributions(df.where("id < 20"), trees, ["x", "y"], "id").groupBy("id", "class").agg(F.sum("phi").alias("phi")).collect()
    at = {r.id: (r.x, r.y) for r in df.where("id < 20").collect()}
    for r in phi:
        assert r.phi == pytest.approx(sum((t.predict(at[r.id]) - t.expected())[r["class"]] for t in trees) / 3)


def test_features_can_be_left_out(spark):
    packs = forests.packed(table(spark), ["x", "y"], "label", 3, fold="fold", trees=3, key=["id"])
    only = forests.fit(packs, held_out=range(3), depth=3, use=["y"])
    assert set(np.unique(only.feature)) == {-1, 1} and [f for f, _ in only.importance()] == ["y"]
    every = forests.fit(packs, held_out=range(3), depth=3)
    assert sum(g for _, g in every.importance()) == pytest.approx(1, abs=1e-6)
    got = {r.features: r.accuracy for r in forests.ablation(table(spark), ["x", "y"], ["y"], "label", 3, 3, 5, 4, ["id"]).collect()}
    assert got["all"] > got["without y"] + 0.1


@pytest.mark.parametrize("name", ["rf_spatial_cv", "rf_importance", "tree_shap", "ablation_without_neighbours"])
def test_forests_of_queries_are_fitted_on_counts(spark, monkeypatch, name):
    made, stored = [], catalog.stored
    monkeypatch.setattr(catalog, "stored", lambda df, n: made.append(n) or stored(df, n))
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
    assert made == ["training", "packs"]


def test_importance_takes_every_fold(spark, monkeypatch):
    made, fit = [], forests.fit
    monkeypatch.setattr(forests, "fit", lambda packs, **k: made.append((packs, list(k["held_out"]))) or fit(packs, **k))
    assert QUERIES["rf_importance"](spark, "/root/testdata/sf0.01").count() == 4
    [(packs, held_out)] = made
    assert held_out == sorted(r.fold for r in packs.table.select("fold").distinct().collect())


def test_the_ablation_takes_every_fold_and_the_cells_around(spark, monkeypatch):
    """Shares of classes around a cell in the year a transition starts from, against plain loops over a mirrored map."""
    made, stored, fits, fit = {}, catalog.stored, [], forests.fit
    monkeypatch.setattr(catalog, "stored", lambda df, n: made.setdefault(n, stored(df, n)))
    monkeypatch.setattr(forests, "fit", lambda packs, **k: fits.append((list(k["held_out"]), k["use"])) or fit(packs, **k))
    folder = "/root/testdata/sf0.001"
    assert QUERIES["ablation_without_neighbours"](spark, folder).count() == 2
    assert [f for f, _ in fits] == [[0, 1, 2, 3, 4]] * 2 and len(fits[0][1]) == 16 and fits[1][1] == ["from_class", "conf_from"]
    held = {}
    view = lambda n: views.spark_view(spark, folder, n, held)
    cells = view("v_map").join(view("v_grid"), "pix").select("year", "r", "c", "class").collect()
    height, at = view("v_grid").agg(F.max("r")).first()[0] + 1, {(x.year, x.r, x.c): x["class"] for x in cells}
    near = lambda i, size: -i - 1 if i < 0 else 2 * size - 1 - i if i >= size else i
    rows = made["training"].collect()
    assert len(rows) == view("v_pairs").where("from_class > 0 AND to_class > 0").count()
    for x in rows:
        seen = [at.get((x.from_year, near(x.r + i, height), near(x.c + j, 125)), 0) for i in (-1, 0, 1) for j in (-1, 0, 1)]
        assert [x[f"nbr3_class{k}_frac"] for k in range(1, 15)] == [seen.count(k) / 9 for k in range(1, 15)]

"""Networks by numerical gradients and learnable series; reports, runs and tables by small cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoweave.functions.expressions import feature_group, feature_label
from geoweave.operators import causal, drivers, evaluate, features, grid, harmonize, models, networks, reports
from geoweave.sources import catalog


@pytest.mark.parametrize("kind", sorted(networks.KINDS))
def test_gradients_and_fit(kind):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(30, 4, 2)), rng.normal(size=30)
    m = networks.KINDS[kind](8 if kind == "dense" else 2, 3)
    _, g = m.gradients(x, y)
    for k in m.p:
        for i in ((0, 0), (m.p[k].shape[0] - 1, m.p[k].shape[1] - 1)):
            m.p[k][i] += 1e-5
            up = m.gradients(x, y)[0]
            m.p[k][i] -= 2e-5
            down = m.gradients(x, y)[0]
            m.p[k][i] += 1e-5
            assert g[k][i] == pytest.approx((up - down) / 2e-5, abs=1e-6)
    target = x[:, -1, 0] - 0.5 * x[:, 1, 1]
    before = ((m.predict(x) - target) ** 2).mean()
    assert ((m.fit(x, target, 300).predict(x) - target) ** 2).mean() < 0.3 * before


@pytest.mark.parametrize("kind", ["recurrent", "attentive"])
def test_rows_lie_along_the_last_axis(kind):
    """States and outputs against the equations row by row; every array of a step has its rows in one line."""
    rng = np.random.default_rng(2)
    x, m = 3 * rng.normal(size=(20, 3, 2)), networks.KINDS[kind](2, 4, 5)
    states, saved = m._unrolled(x)
    assert states.shape == (3, 4, 20) and all(a.shape[-1] == 20 and a.flags.c_contiguous for step in saved for a in step)
    for i in range(20):
        h, one = np.zeros(4), np.ones(1)
        for t in range(3):
            u = np.concatenate([x[i, t], h, one])
            z, r = (1 / (1 + np.exp(-u @ m.p[g])) for g in "zr")
            h = (1 - z) * h + z * np.tanh(np.concatenate([x[i, t], r * h, one]) @ m.p["h"])
            assert states[t, :, i] == pytest.approx(h, abs=1e-12)
    assert m.predict(x[:0]).shape == (0,)


def test_attention_adds_up():
    x = np.random.default_rng(1).normal(size=(9, 5, 2))
    weights = networks.AttentiveNode(2, 4).attention(x)
    assert weights.shape == (9, 5) and np.allclose(weights.sum(axis=1), 1)


def test_neighbours_help_where_they_drive(spark):
    """Every node follows its ring neighbours' last values."""
    rng, n = np.random.default_rng(3), 40
    s = rng.normal(size=(14, n))
    for t in range(1, 14):
        s[t] = 0.5 * (np.roll(s[t - 1], 1) + np.roll(s[t - 1], -1)) + 0.4 * rng.normal(size=n)
    panel = spark.createDataFrame([(i, t, float(s[t, i])) for t in range(14) for i in range(n)], "node int, t int, value double")
    ring = spark.createDataFrame([(i, (i + d) % n, 0.5) for i in range(n) for d in (-1, 1)], "src int, dst int, w double")
    got = {r.model: r for r in networks.compared(panel, ring, ["value"], "value", 11, kinds=("recurrent",), rounds=120).collect()}
    assert got["recurrent, neighbours"].r2 > got["recurrent, own"].r2 + 0.1 and got["recurrent, own"].spillover


def _ring(neighbours: float, own: float, seed: int = 3, n: int = 40, steps: int = 14):
    """Values that follow the ring neighbours' and the own last values."""
    rng = np.random.default_rng(seed)
    s = rng.normal(size=(steps, n))
    for t in range(1, steps):
        s[t] = neighbours * (np.roll(s[t - 1], 1) + np.roll(s[t - 1], -1)) / 2 + own * s[t - 1] + 0.3 * rng.normal(size=n)
    return [(i, t, float(s[t, i])) for t in range(steps) for i in range(n)], [(i, (i + 1) % n) for i in range(n)]


def test_gradients_of_tasks_add_up_to_those_of_all_windows(spark):
    panel, _ = _ring(0.5, 0.3)
    rows = networks.windows(spark.createDataFrame(panel, "node int, t int, value double"), "node", "t", ["value"], "value", 3).repartition(5)
    local = rows.toPandas()
    x = local[["value_3", "value_2", "value_1"]].to_numpy(float).reshape(len(local), 3, 1)
    for kind in networks.KINDS:
        fitted, losses = networks.fitted(rows, {"one": (kind, ["value"])}, "value", 3, rounds=6)
        plain = networks.KINDS[kind](3 if kind == "dense" else 1, 8, 0)
        assert losses[0]["one"] == pytest.approx(plain.gradients(x, local["value"].to_numpy(float))[0], rel=1e-9)
        plain.fit(x, local["value"].to_numpy(float), 6)
        assert all(np.allclose(fitted["one"].p[k], plain.p[k], atol=1e-8) for k in plain.p)
        assert losses[-1]["one"] < losses[0]["one"]


def test_judging_rows_stop_a_fit_and_give_no_gradients(spark):
    panel, _ = _ring(0.5, 0.3)
    rows = networks.windows(spark.createDataFrame(panel, "node int, t int, value double"), "node", "t", ["value"], "value", 3)
    noisy = rows.withColumn("late", F.col("t") > 9).withColumn("value", F.when(F.col("t") > 9, -3 * F.col("value_1")).otherwise(F.col("value_1"))).cache()
    models_, losses = networks.fitted(noisy, {"one": ("dense", ["value"])}, "value", 3, judged="late", rounds=30, patience=3)
    assert len(losses) < 30 and losses[-1]["one"] >= min(x["one"] for x in losses)
    none, nothing = networks.fitted(noisy.limit(0), {"one": ("dense", ["value"])}, "value", 3, rounds=5)
    assert len(nothing) == 1 and set(none) == {"one"}


def test_spillover_is_found_where_it_is_and_not_elsewhere(spark):
    for neighbours, own, want in ((0.8, 0.0, True), (0.0, 0.8, False)):
        panel, edges = _ring(neighbours, own, n=150)
        got = networks.spillover_test(spark.createDataFrame(panel, "node int, t int, value double"), spark.createDataFrame(edges, "src int, dst int"), ["value"], "value", 11, rounds=60).collect()
        assert {r.model for r in got} == {"own", "own and neighbours"} and {r.n for r in got} == {450}
        assert {r.spillover for r in got} == {want}, got


def test_boosted_trees_and_ablation(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i % 3), float(a), float(b), int(a > 0) + int(b > 0.5)) for i, (a, b) in enumerate(rng.normal(size=(240, 2)))]
    df = spark.createDataFrame(rows, "fold int, a double, nbr3_b double, y int").cache()
    boosted = models.train_boosted(df, ["a", "nbr3_b"], "y", 5, 3)
    right = boosted.transform(models.assemble(df, ["a", "nbr3_b"])).where("prediction = y").count()
    assert right > 220
    got = {r.features: r.accuracy for r in models.ablation(df, ["a", "nbr3_b"], ["nbr3_"], "y", 3, 3, lambda d, f, y: models.train_forest(d, f, y, 5, 4)).collect()}
    assert got["all"] > got["without nbr3_"] + 0.1
    _, held = models.folds_predicted(df, ["a", "nbr3_b"], "y", 3, lambda d, f, y: models.train_forest(d, f, y, 3, 3))
    gains = models.importance(held, ["a", "nbr3_b"])
    assert sum(g for _, g in gains) == pytest.approx(1, abs=1e-6) and len(gains) == 2


def test_shares_caps_and_water(spark):
    df = spark.createDataFrame([(i, float(i), i % 3) for i in range(100)], "id int, v double, class int")
    assert reports.display_cap(df, "v", 0.5).agg(F.max("shown")).first()[0] == 49.5
    got = {r.limit: (r.n, r.pct) for r in reports.shares_over(df, "v", (89.5, 1000.0)).collect()}
    assert got == {89.5: (10, 10.0), 1000.0: (0, 0.0)}
    water = reports.without_water(df, "class", "v", (2,))
    assert water.where("is_water AND v IS NULL").count() == 33 and water.where("NOT is_water AND v IS NULL").count() == 0


def test_digest_is_that_of_sorted_json(spark):
    row = spark.range(1).select(reports.digest(year=F.lit(2020), name=F.lit("x"), cap=F.lit(0.5)).alias("d")).first()
    assert row.d == reports.settings_digest({"cap": 0.5, "name": "x", "year": 2020}) and len(row.d) == 10


def test_runs_skip_force_and_stop():
    seen = []

    def bad():
        raise ValueError("no")

    steps = [("a", lambda: seen.append("a")), ("b", lambda: seen.append("b")), ("c", bad), ("d", lambda: seen.append("d"))]
    got = reports.run_steps(steps, done=lambda n: n == "a")
    assert [(n, s.split(":")[0]) for n, s, _ in got] == [("a", "skipped"), ("b", "done"), ("c", "failed")] and seen == ["b"]
    assert [n for n, _, _ in reports.run_steps(steps, first="a", last="b", force=True)] == ["a", "b"] and seen == ["b", "a", "b"]


def test_environment_report_and_documents(spark):
    assert {r.name: r.ok for r in reports.environment(spark).collect()}["numpy"]
    text = reports.diagnosis("Check", {"One": spark.range(2)})
    assert text.startswith("# Check\n\n## One\n\n| id |") and catalog.latex(spark.range(1)).startswith(r"\begin{tabular}")
    marks = reports.placemarks(spark.createDataFrame([("a & b", 1.0, 2.0, "t")], "n string, x double, y double, t string"), "n", "x", "y", "t")
    assert "<name>a &amp; b</name>" in reports.kml(marks, "points")


def test_feature_names(spark):
    names = ["ndvi_gs_mean_slope5y", "my_glw", "slope", "slopes", "popdens", "nbr3_class4_frac", "road_distance_km"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = {r.n: (r.g, r.l) for r in df.select("n", feature_group(F.col("n")).alias("g"), feature_label(F.col("n")).alias("l")).collect()}
    assert [got[n][0] for n in names] == ["Vegetation productivity", "Livestock/grazing", "Terrain", "Other", "Population", "Neighbour class (autocorr.)", "Infrastructure"]
    assert got["ndvi_gs_mean_slope5y"][1] == "ndvi gs mean slope over 5 years"


def test_false_discovery_of_few_values(spark):
    """Very many rows with few p-values, as counts of surrogates give them, and some near zero."""
    p = [0.005] * 40 + [0.01] * 300 + [0.5] * 500 + [1e-12, 1e-9, 0.0, 1.0]
    got = {r.p_value: r.q_value for r in causal.benjamini_hochberg(spark.createDataFrame([(v,) for v in p], "p_value double")).collect()}
    ordered, n, least = sorted(p), len(p), 1.0
    for rank in range(n, 0, -1):
        least = min(least, ordered[rank - 1] * n / rank)
        if rank == 1 or ordered[rank - 2] != ordered[rank - 1]:
            assert got[ordered[rank - 1]] == pytest.approx(least)


def test_ranks_of_many_distinct_values(spark):
    rng = np.random.default_rng(7)
    v = np.concatenate([rng.normal(size=500), rng.normal(size=50) * 1e-9, np.zeros(20), np.repeat(3.0, 30)])
    got = {r.i: r["rank"] for r in models.average_rank(spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "i int, v double"), "v").collect()}
    for i, x in enumerate(v):
        assert got[i] == math.floor((v > x).sum() + ((v == x).sum() + 1) / 2)


def test_distances_on_a_large_sparse_grid(spark):
    rng = np.random.default_rng(9)
    roads = {(int(r), int(c)) for r, c in rng.integers(0, 40, (6, 2))}
    cells = spark.createDataFrame([(r, c) for r in range(40) for c in range(40)], "r int, c int")
    got = {(x.r, x.c): x.d2 for x in grid.distance_squared(cells, spark.createDataFrame(sorted(roads), "r int, c int"), 40, 40).collect()}
    assert all(got[r, c] == min((r - a) ** 2 + (c - b) ** 2 for a, b in roads) for r in range(40) for c in range(40))
    none = grid.distance_squared(cells, spark.createDataFrame([], "r int, c int"), 40, 40)
    assert none.where("d2 IS NOT NULL").count() == 0 and none.count() == 1600


def test_layers_are_anchored_and_ties_go_back(spark):
    rows = [(1, "glw", y, v) for y, v in ((2010, 5.0), (2020, 9.0))] + [(1, "cdd", y, float(y - 1990)) for y in range(1990, 2016)] + [(2, "cdd", 2000, 1.0), (2, "cdd", 2001, None)]
    long = spark.createDataFrame(rows, "pix int, variable string, year int, value double")
    got = {(r.pix, r.variable, r.year): r for r in features.long_features(long, (2015, 2020), slopes=((5, 3), (10, 5)), baseline=(1990, 2019, 10)).collect()}
    assert got[1, "glw", 2015].state == 5.0 and got[1, "glw", 2020].state == 9.0 and got[1, "glw", 2015].slope5y is None
    assert got[1, "cdd", 2015].slope5y == pytest.approx(1) and got[1, "cdd", 2015].slope10y == pytest.approx(1)
    assert got[1, "cdd", 2020].state == 25.0 and got[1, "cdd", 2020].slope5y is None and got[1, "cdd", 2020].slope10y == pytest.approx(1)
    assert got[1, "cdd", 2015].anomaly == pytest.approx(25 - 12.5) and got[2, "cdd", 2015].anomaly is None
    at = {(r.pix, r.variable, r.year): r for r in features.long_features(long, (2020,), slopes=((5, 3),), at_state=True).collect()}
    assert at[1, "cdd", 2020].slope5y == pytest.approx(1)
    assert features.long_features(long.limit(0), (2015,), slopes=((5, 3),)).count() == 0


def test_unknown_driver_groups_and_names(spark):
    with pytest.raises(ValueError):
        drivers.aligned(["weather"], {}, spark.range(1))
    with pytest.raises(ValueError):
        catalog.resolved(spark.range(1), {"time": ("time", "date")})
    assert set(drivers.GROUPS) >= {"climate", "grazing", "cropping", "livestock"}


def test_samples_and_shares(spark):
    df = spark.createDataFrame([(i, i % 4) for i in range(20000)], "id int, class int")
    n = evaluate.held_out(df, "id", 0.1, 500).where("held").count()
    assert 1800 < n < 2200 and evaluate.held_out(df.limit(300), "id").where("held").count() == 300
    folds = [r["count"] for r in evaluate.random_folds(df, "id").groupBy("fold").count().collect()]
    assert len(folds) == 5 and min(folds) > 3500
    got = harmonize.histogram_shares(spark.createDataFrame([(1,)] * 3 + [(2,)] * 5, "v int"), "v").collect()
    assert [(r.v, r.n, r.pct, r["rank"]) for r in sorted(got, key=lambda r: r["rank"])] == [(2, 5, 62.5, 1), (1, 3, 37.5, 2)]
    assert [r.v for r in harmonize.most_frequent(spark.createDataFrame([(1,), (2,), (2,)], "v int"), 1, "v").collect()] == [2]

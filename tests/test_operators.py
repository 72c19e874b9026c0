"""Operators against hand-made values, properties and restatements in NumPy."""

import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from geoweave.functions import dims
from geoweave.functions.expressions import Albers, direction_gradient, direction_strict, safe_corr
from geoweave.operators import causal, evaluate, features, fusion, graph, grid, harmonize, models, transitions
from geoweave.sources import catalog
from geoweave.streaming import drought


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


CROSSWALK_VECTORS = {
    1: {0: 0, 1: 1, 5: 5, 9: 9, 13: 13, 14: 14},
    3: {0: 0, 1: 9, 2: 1, 4: 4, 5: 8, 6: 14, 7: 11, 8: 10, 9: 7},
    2: {0: 0, 10: 9, 130: 4, 190: 10, 200: 11, 202: 13, 210: 8, 220: 14},
    4: {0: 0, 10: 9, 130: 4, 190: 10, 200: 11, 202: 13, 210: 8, 220: 14, 32767: 0},
    5: {0: 0, 1: 1, 5: 1, 8: 4, 10: 4, 11: 7, 12: 9, 13: 10, 15: 14, 16: 11, 17: 8, 255: 0},
    6: {0: 0, 10: 1, 20: 2, 30: 4, 40: 9, 50: 10, 60: 11, 70: 14, 80: 8, 90: 7, 100: 4},
}


def test_crosswalk_vectors_and_unknown_codes(spark):
    assert sum(map(len, dims.CROSSWALK.values())) == 142
    rows = [(p, n, u) for p, v in CROSSWALK_VECTORS.items() for n, u in v.items()] + [(1, 99, 0), (8, -3, 0)]
    got = harmonize.remap(frame(spark, rows, "product_id int, native int, want int"), dims.crosswalk(spark))
    assert got.where("unified <> want").count() == 0
    unknown = harmonize.unknown_codes(frame(spark, rows, "product_id int, native int, want int"), dims.crosswalk(spark))
    assert {(r.product_id, r.native) for r in unknown.collect()} == {(1, 99), (8, -3)}


def fuse_one(spark, votes, prior=None):
    rows = frame(spark, [(0, 2020, p, u) for p, u in votes.items()], "pix int, year int, product_id int, unified int")
    cells = frame(spark, [(0, 2020)], "pix int, year int")
    names = [f"l1_{k}" for k in dims.L1_CLASSES] + [f"l2_{m}" for ms in dims.SUBCLASSES.values() for m in ms]
    flat = {**{f"l1_{k}": 1 / 9 for k in dims.L1_CLASSES}, **{f"l2_{m}": 1 / len(ms) for ms in dims.SUBCLASSES.values() for m in ms}}
    flat |= prior or {}
    p = frame(spark, [tuple(flat[n] for n in names)], ", ".join(f"{n} double" for n in names))
    return fusion.fuse(rows, cells, p).first()


def test_no_votes_is_the_prior(spark):
    r = fuse_one(spark, {}, {"l1_2": 0.5})
    assert (r.map_l1, r.fused, r.agreement) == (2, 2, 0)


def test_one_vote_within_grassland(spark):
    r = fuse_one(spark, {1: 3})
    assert r.fused == 3 and r.agreement == 1
    assert r.post_l2 == pytest.approx(0.99 / (0.99 + 3 * (0.01 / 3)))


def test_specialists_vote_only_in_their_field(spark):
    # The sandy-land product and the grassland mask have nothing to say about forest.
    assert fuse_one(spark, {7: 1, 8: 1, 3: 9}).fused == 9


@pytest.mark.parametrize("votes", [{1: 12, 7: 13, 2: 11}, {1: 4, 8: 4, 3: 4, 5: 9}, {2: 1, 3: 2, 4: 1, 5: 1, 6: 9}])
def test_fusion_matches_numpy(spark, votes):
    lp = np.log(np.full(9, 1 / 9) + 1e-12)
    for p, u in votes.items():
        l1, e = dims.UNIFIED_TO_L1[u], dims.error_rate(dims.PRODUCTS[p][1])
        spec = dims.PRODUCTS[p][-1]
        if u and (not spec or l1 in spec):
            lp += [math.log(1 - e) if k == l1 else math.log(e / 8) for k in range(1, 10)]
    post = np.exp(lp - lp.max())
    post /= post.sum()
    r = fuse_one(spark, votes)
    assert r.map_l1 == int(np.argmax(post)) + 1
    assert r.post_l1 == pytest.approx(post.max())
    assert r.conf_joint + r.decision_entropy == 100 and 0 <= r.conf_joint <= r.conf_l1


def test_transition_schemes(spark):
    rows = frame(spark, [(4, 1), (1, 4), (12, 13), (13, 12), (9, 4), (12, 5)], "a int, b int")
    got = rows.select(direction_gradient(F.col("a"), F.col("b")), direction_strict(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in got] == [("recovery", "recovery"), ("degradation", "degradation"), ("recovery", "arid reshuffle"), ("degradation", "arid reshuffle"), ("agricultural", "agricultural"), ("recovery", "recovery")]


def test_matrix_sums_and_rates(spark):
    maps = frame(spark, [(i, y, 1 + (i * (1 + (y > 2000))) % 3) for i in range(30) for y in (2000, 2005)] + [(99, 2000, 1)], "pix int, year int, class int")
    pairs = transitions.pairs(maps, keep=("class",))
    counts = transitions.count_pairs(transitions.valid(pairs), "from_year")
    full = transitions.matrix(counts, dims.legend(spark))
    assert full.agg(F.sum("n")).first()[0] == 30
    pct = transitions.matrix_percent(full).groupBy("from_class").agg(F.sum("pct").alias("s")).collect()
    assert all(abs(r.s - 100) < 0.05 for r in pct if r.s is not None)
    assert transitions.change_rates(pairs).first().n_valid_both == 30


def test_benjamini_hochberg(spark):
    rows = frame(spark, [(0, 0.01), (1, 0.04), (2, 0.03), (3, 0.2), (4, None)], "i int, p_value double")
    got = {r.i: r.q_value for r in causal.benjamini_hochberg(rows).collect()}
    assert got[4] is None
    assert [got[i] for i in range(4)] == pytest.approx([0.04, 0.16 / 3, 0.16 / 3, 0.2])


def test_nearest_year_ties_to_the_earlier(spark):
    got = features.nearest_year(frame(spark, [(2015,), (2021,)], "year int"), frame(spark, [(2010,), (2020,)], "year int")).collect()
    assert {r.target: r.source_year for r in got} == {2015: 2010, 2021: 2020}


def test_trailing_slope(spark):
    rows = frame(spark, [(1, 2001, 1.0), (1, 2002, 2.0), (1, 2003, None), (1, 2004, 5.0), (1, 2006, 9.0)], "e int, year int, v double")
    got = {r.year: r.slope for r in features.trailing_slope(rows, "e", "year", "v", 5).collect()}
    assert got[2001] is None and got[2002] is None and got[2003] is None
    assert got[2004] == pytest.approx(1.357143, abs=1e-6)
    assert got[2006] == pytest.approx(1.75)


def test_reflected_edges_count_the_corner_four_times(spark):
    cells = frame(spark, [(r, c, 1 if (r, c) == (0, 0) else 2) for r in range(3) for c in range(3)], "r int, c int, class int")
    got = {(x.r, x.c): x.n for x in grid.class_fractions(cells, 3, 3, [1, 2]).where("class = 1").collect()}
    assert got[(0, 0)] == 4 and got[(1, 1)] == 1 and got[(0, 1)] == 2
    total = grid.class_fractions(cells, 3, 3, [1, 2]).groupBy("r", "c").agg(F.sum("n").alias("n")).collect()
    assert all(x.n == 9 for x in total)


@pytest.mark.parametrize("given_cells,filled", [(4, False), (5, True)])
def test_gap_fill_needs_enough_neighbours(spark, given_cells, filled):
    rows = [(3, 3, None)] + [(r, c, 2.0) for r, c in [(0, 0), (6, 6), (3, 4), (2, 2), (0, 6)][:given_cells]] + [(7, 7, 100.0)]
    got = grid.gap_fill(frame(spark, rows, "r int, c int, value double")).where("r = 3 AND c = 3").first().value
    assert got == (2.0 if filled else None)


def test_median_pads_with_zeros(spark):
    rows = frame(spark, [(0, 0, 5.0), (0, 1, 4.0), (1, 0, None)], "r int, c int, value double")
    assert {(r.r, r.c): r.value for r in grid.median_filter(rows).collect()} == {(0, 0): 0.0, (0, 1): 0.0}


def test_block_mode_tie_is_the_lowest_and_none_is_zero(spark):
    rows = frame(spark, [(0, 0, 5), (0, 1, 4), (1, 0, 4), (1, 1, 5), (0, 2, 0), (0, 3, None), (1, 2, 0), (1, 3, 0)], "r int, c int, class int")
    assert {(r.br, r.bc): r["class"] for r in grid.coarsen_mode(rows, 2, 2, 4).collect()} == {(0, 0): 4, (0, 1): 0}


def test_distance_is_exact(spark):
    rng = np.random.default_rng(3)
    road = {tuple(x) for x in rng.integers(0, 12, (7, 2)).tolist()}
    cells = frame(spark, [(r, c) for r in range(12) for c in range(12)], "r int, c int")
    got = grid.distance_squared(cells, frame(spark, sorted(road), "r int, c int"), 12, 12).collect()
    assert all(x.d2 == min((x.r - a) ** 2 + (x.c - b) ** 2 for a, b in road) for x in got)
    assert grid.distance_squared(cells, frame(spark, [], "r int, c int"), 12, 12).where("d2 IS NOT NULL").count() == 0


def test_percentile_and_description(spark):
    rows = frame(spark, [("v", x) for x in (1.0, 2.0, 4.0, 8.0, None, math.nan)], "k string, x double")
    r = harmonize.describe_continuous(rows, "x", "k").first()
    assert r.p95 == pytest.approx(7.4) and (r.n_valid, r.n_null) == (4, 2)


def test_albers_round_trip(spark):
    points = frame(spark, [(100.0, 38.0), (105.0, 40.0), (126.0, 53.0)], "lon double, lat double")
    a = Albers()
    x, y = a.forward(F.col("lon"), F.col("lat"))
    lon, lat = a.inverse(F.col("x"), F.col("y"))
    for r in points.withColumns({"x": x, "y": y}).withColumns({"lon2": lon, "lat2": lat}).collect():
        assert r.lon2 == pytest.approx(r.lon, abs=1e-9) and r.lat2 == pytest.approx(r.lat, abs=1e-8)


def test_safe_corr(spark):
    rows = frame(spark, [("c", 1.0, 2.0), ("c", 1.0, 3.0), ("c", 1.0, 4.0), ("ok", 1.0, 1.0), ("ok", 2.0, 2.0), ("ok", 4.0, 3.0), ("ok", None, 9.0), ("few", 1.0, 2.0), ("few", 2.0, 1.0)], "k string, x double, y double")
    got = {r.k: r.rho for r in rows.groupBy("k").agg(safe_corr(F.col("x"), F.col("y")).alias("rho")).collect()}
    assert got["c"] is None and got["few"] is None
    assert got["ok"] == pytest.approx(np.corrcoef([1, 2, 4], [1, 2, 3])[0, 1])


def test_cross_map_finds_the_direction(spark):
    rows = [("s", t, x, y) for t, x, y in causal.coupled_logistic(300)]
    df = frame(spark, rows, "k string, t int, x double, y double")
    forward = causal.ccm_full(df, "x", "y", ["k"]).first().rho
    reverse = causal.ccm_full(df, "y", "x", ["k"]).first().rho
    assert forward == pytest.approx(0.824557, abs=1e-5) and reverse == pytest.approx(-0.200889, abs=1e-5)
    x, y = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    assert causal.cross_map(y, x) == pytest.approx(forward)
    small = causal.ccm_bootstrap(df, "x", "y", ["k"], (5, 100), 3)
    assert causal.convergence(small, ["k"]).first().convergence > 0.05


def test_granger(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=80)
    y = np.r_[0, 0.8 * x[:-1]] + 0.1 * rng.normal(size=80)
    best = causal.granger(y, x)
    assert best["p_value"] < 1e-6 and causal.granger(x, rng.normal(size=80))["p_value"] > 1e-4
    df = frame(spark, [("k", t, float(a), float(b)) for t, (a, b) in enumerate(zip(y, x))], "k string, t int, y double, x double")
    f = causal.granger_lag1(df, "y", "x", ["k"]).first().f_stat
    own, other = np.stack([np.ones(79), y[:-1]], 1), np.stack([np.ones(79), y[:-1], x[:-1]], 1)
    small, large = causal._ssr(own, y[1:]), causal._ssr(other, y[1:])
    assert f == pytest.approx((small - large) / (large / 76))
    assert causal.f_tail(4.0, 1, 10) == pytest.approx(0.0734, abs=1e-4)


def test_surrogates_keep_the_spectrum():
    x = np.random.default_rng(0).normal(size=31)
    for n in (31, 30):
        many = causal.surrogates(x[:n], 5, np.random.default_rng(1))
        assert np.allclose(np.abs(np.fft.rfft(many, axis=1)), np.abs(np.fft.rfft(x[:n]))) and np.allclose(many.mean(axis=1), x[:n].mean())
        assert len({s.tobytes() for s in many}) == 5
    effect = np.random.default_rng(2).normal(size=40).cumsum()
    assert np.allclose(causal.cross_maps(effect, np.stack([effect, -effect])), causal.cross_map(effect, effect))


def test_graph(spark):
    nodes = frame(spark, [(r * 10 + c, r, c, float(r + c)) for r in range(3) for c in range(3)] + [(99, 9, 9, 1.0)], "node int, br int, bc int, value double")
    edges = graph.queen_edges(nodes)
    assert edges.count() == 20 and edges.where("src >= dst").count() == 0
    degree = graph.both_ways(edges).groupBy("src").count().agg(F.max("count")).first()[0]
    assert degree <= 8
    means = {r.node: r.nbr_value for r in graph.neighbour_mean(nodes, edges, ["value"]).collect()}
    assert means[99] == 0.0 and means[11] == pytest.approx(2.0)
    w = {(r.src, r.dst): r.w for r in graph.normalised_adjacency(nodes, edges).collect()}
    assert w[(99, 99)] == 1.0 and w[(0, 11)] == pytest.approx(1 / math.sqrt(4 * 9)) and w[(11, 0)] == w[(0, 11)]


def test_lattice_diffusion_has_spillover(spark):
    rng = np.random.default_rng(5)
    n = 12
    s = rng.normal(size=(n, n))
    rows = []
    for t in range(8):
        mean = sum(np.roll(s, d, a) for d in (1, -1) for a in (0, 1)) / 4
        new = 0.7 * mean + 0.1 * s + 0.15 * rng.normal(size=(n, n))
        rows += [(r * n + c, t, float(s[r, c]), float(mean[r, c]), float(new[r, c])) for r in range(n) for c in range(n)]
        s = new
    df = frame(spark, rows, "node int, t int, own double, nbr double, y double")
    got = {r.model: r.r2 for r in models.spillover(df.where("node % 5 > 0"), df.where("node % 5 = 0"), ["own"], ["nbr"], "y").collect()}
    assert got["gap"] > 0.1 and got["spillover"] == 1.0


def test_tree_attributions_add_up(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 3))
    df = spark.createDataFrame(pd.DataFrame({"k": range(200), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": (x[:, 0] + x[:, 1] > 0).astype(int) + (x[:, 2] > 1)}))
    forest = models.train_forest(df, ["a", "b", "c"], "y", 3, 4)
    trees = models.exported_trees(forest)
    for row in x[:10]:
        phi = sum(models.tree_attributions(t, row, 3)[0] for t in trees)
        want = sum(t.predict(row) - t.expected() for t in trees)
        assert np.allclose(phi.sum(axis=0), want)


def test_tree_attributions_are_shapley_values():
    tree = models.Tree([1, 3, -1, -1, -1], [2, 4, -1, -1, -1], [0, 1, -1, -1, -1], [0.0, 0.0, 0, 0, 0], [10, 6, 4, 2, 4], [[0], [0], [5.0], [1.0], [3.0]])

    def value(known, x, node=0):
        if tree.left[node] < 0:
            return tree.values[node][0]
        l, r = tree.left[node], tree.right[node]
        if tree.feature[node] in known:
            return value(known, x, l if x[tree.feature[node]] <= tree.threshold[node] else r)
        return (tree.cover[l] * value(known, x, l) + tree.cover[r] * value(known, x, r)) / tree.cover[node]

    x = (-1.0, 1.0)
    want = [(value({0}, x) - value(set(), x) + value({0, 1}, x) - value({1}, x)) / 2, (value({1}, x) - value(set(), x) + value({0, 1}, x) - value({0}, x)) / 2]
    assert np.allclose(models.tree_attributions(tree, x, 2)[0, :, 0], want)


def test_recurrent_gradients_and_fit():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(20, 4, 2)), rng.normal(size=20)
    m = models.RecurrentNode(2, 3)
    _, g = m.gradients(x, y)
    for k in m.p:
        i = (0, 0)
        m.p[k][i] += 1e-5
        up = m.gradients(x, y)[0]
        m.p[k][i] -= 2e-5
        down = m.gradients(x, y)[0]
        m.p[k][i] += 1e-5
        assert g[k][i] == pytest.approx((up - down) / 2e-5, abs=1e-6)
    before = m.gradients(x, y)[0]
    assert m.fit(x, y, 60).gradients(x, y)[0] < before


def test_folds_are_balanced_and_samples_repeat(spark):
    cells = frame(spark, [(i, (i % 40 - 20) * 50_000.0, (i // 40) * 50_000.0) for i in range(1600)], "pix int, x double, y double")
    folds = evaluate.spatial_folds(cells)
    blocks = folds.select("block", "fold").distinct().groupBy("fold").count().collect()
    assert len(blocks) == 5 and max(r["count"] for r in blocks) - min(r["count"] for r in blocks) <= 1
    s = evaluate.stratified_sample(folds, "fold", "pix", 7)
    assert s.groupBy("fold").count().where("count <> 7").count() == 0
    assert {r.pix for r in s.collect()} == {r.pix for r in evaluate.stratified_sample(folds, "fold", "pix", 7).collect()}
    assert evaluate.stride_sample(cells.select("pix", (F.col("pix") % 40).alias("c"), F.floor(F.col("pix") / 40).alias("r")), 7).count() == -(-1600 // 7)


def test_metadata_union_and_reference_points(spark):
    a = frame(spark, [(1, 2000, 0.5)], "pix int, year int, clim_CDD double")
    b = frame(spark, [(1, 2005)], "pix int, year int")
    u = features.union_years([a, b])
    assert u.where("clim_CDD IS NULL").count() == 1
    assert {r["column"]: r["group"] for r in features.feature_metadata(u).collect()} == {"pix": "other", "year": "geometry", "clim_CDD": "climate"}
    points = frame(spark, [(1, "3"), (1, " 4.0 "), (1, ""), (1, "x"), (1, "0"), (1, None)], "mapped int, reference string")
    assert sorted(r.reference for r in evaluate.reference_points(points).collect()) == [3, 4]


def test_files_are_written_by_year_and_read_pruned(spark, tmp_path):
    df = frame(spark, [(i, 2000 + i % 2 * 5, float(i)) for i in range(10)], "pix int, year int, v double")
    catalog.write_pixels(df, str(tmp_path / "t"))
    catalog.write_pixels(df.where("year = 2005").withColumn("v", F.lit(1.0)), str(tmp_path / "t"))
    got = catalog.read_pixels(spark, str(tmp_path / "t"), columns=("pix", "v"), year=2005)
    assert got.count() == 5 and got.where("v <> 1").count() == 0
    assert catalog.read_pixels(spark, str(tmp_path / "t"), year=2000).count() == 5
    assert "| pix | year | v |" in catalog.markdown(df) and "tabular" in catalog.latex(df)
    files = frame(spark, [("x/a_2003_b.tif",), ("x/none.tif",)], "path string")
    assert [r.year for r in catalog.file_years(files).collect()] == [2003]


def test_streamed_statistics(spark, tmp_path):
    rows = frame(spark, [("2024-01-01 00:00:00", 1, -2.0), ("2024-01-02 00:00:00", 1, 2.0), ("2024-01-02 00:00:00", 2, -1.2)], "ts string, pixel int, z double").withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = drought.windowed_statistics(stream).writeStream.format("memory").queryName("drought_test").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.pixel: r for r in spark.table("drought_test").collect()}
    assert (got[1].n_severe_drought, got[1].n_wet, got[2].n_moderate_drought) == (1, 1, 1)


@settings(max_examples=40, deadline=None)
@given(st.floats(0.01, 50), st.integers(1, 6), st.integers(3, 60))
def test_f_tail_is_a_probability(f, d1, d2):
    assert 0 <= causal.f_tail(f, d1, d2) <= 1 and causal.f_tail(f * 1.5, d1, d2) <= causal.f_tail(f, d1, d2) + 1e-12


@settings(max_examples=30, deadline=None)
@given(st.floats(0.0, 1.2), st.floats(-0.5, 0.5))
def test_error_rate_bounds(w, d):
    assert 0.01 <= dims.error_rate(w, d) <= 0.99

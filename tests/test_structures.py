"""Quantiles by ranges, spans of scan lines, bucketed maps, the manifest, permutations, accuracy by area."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoweave.operators import drivers, evaluate, grid, manifest
from geoweave.operators.quantiles import exact_quantiles
from geoweave.sources import bucketed


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(0)
    groups = {
        "normal": rng.normal(size=501), "ties": rng.integers(-2, 3, 400).astype(float), "one": np.array([3.5]), "same": np.full(50, -7.25),
        "wide": np.concatenate([rng.lognormal(0, 8, 300), -rng.lognormal(0, 8, 300), np.zeros(5)]), "near": 1 + rng.random(300) * 1e-9,
    }
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("ties", None), ("ties", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    shares = (0.0, 0.05, 0.5, 0.95, 0.99, 1.0)
    got = {r.k: r for r in exact_quantiles(df, "v", shares, "k").collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        assert [got[k][f"q{i}"] for i in range(len(shares))] == pytest.approx(np.quantile(vs, shares).tolist(), rel=1e-9, abs=1e-12)
    whole = np.concatenate(list(groups.values()))
    assert exact_quantiles(df, "v", [0.5]).first().q0 == pytest.approx(np.median(whole))
    assert exact_quantiles(df.where("k = 'none'"), "v", [0.5], "k").count() == 0
    assert [r.q0 for r in exact_quantiles(df.where("k = 'none'"), "v", [0.5]).collect()] == [None]


def parity(edges, r, c):
    y, n = r + 0.5, 0
    for x1, y1, x2, y2 in edges:
        if (y1 <= y) != (y2 <= y) and x1 + (y - y1) / (y2 - y1) * (x2 - x1) > c + 0.5:
            n += 1
    return n % 2 == 1


def ring(points):
    return [(*a, *b) for a, b in zip(points, points[1:] + points[:1])]


def test_spans_fill_holes_parts_and_stars(spark):
    rng = np.random.default_rng(2)
    shapes = [ring([(1.0, 1.0), (18.0, 2.5), (16.5, 17.0), (2.0, 15.5)]) + ring([(5.0, 5.0), (11.0, 5.5), (10.0, 11.0), (5.5, 10.0)]), ring([(2.0, 2.0), (6.0, 2.0), (6.0, 6.0), (2.0, 6.0)]) + ring([(30.0, -5.0), (45.0, 3.0), (28.0, 9.0)])]
    for k in range(6):
        angle = np.sort(rng.random(15)) * 2 * np.pi
        size = rng.uniform(3, 14, 15)
        shapes.append(ring([(20 + float(s * np.cos(a)), 12 + float(s * np.sin(a))) for s, a in zip(size, angle)]))
    edges = spark.createDataFrame([(i, *e) for i, es in enumerate(shapes) for e in es], "poly int, x1 double, y1 double, x2 double, y2 double")
    cells = spark.createDataFrame([(r, c) for r in range(24) for c in range(40) if (r + c) % 11], "r int, c int")
    got = {tuple(x) for x in grid.burn_polygons(cells, edges).select("poly", "r", "c").collect()}
    want = {(i, r, c) for i, es in enumerate(shapes) for r in range(24) for c in range(40) if (r + c) % 11 and parity(es, r, c)}
    assert got == want and len(want) > 500
    plan = grid.scanline_spans(edges, grid.extent_of(cells))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan
    joined = grid.burn_polygons(cells, edges)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in joined.split("\n") if "Join Inner" in line and (">" in line.split("Join Inner")[1] or "<" in line.split("Join Inner")[1])]


def test_lines_pass_the_cells_that_they_touch(spark):
    rng = np.random.default_rng(3)
    lines = [tuple(float(v) for v in rng.uniform(-3, 23, 4)) for _ in range(30)] + [(2.0, 5.5, 9.0, 5.5), (4.5, 1.0, 4.5, 8.0), (3.2, 3.3, 3.4, 3.6)]
    bounds = spark.createDataFrame([(0, 19, 0, 19)], "r0 int, r1 int, c0 int, c1 int")
    got = {tuple(x) for x in grid.cells_crossed(spark.createDataFrame([(i, *x) for i, x in enumerate(lines)], "id int, x1 double, y1 double, x2 double, y2 double"), bounds, "id").collect()}
    for i, (x1, y1, x2, y2) in enumerate(lines):
        t = np.linspace(0, 1, 20001)
        seen = set(zip(np.floor(y1 + t * (y2 - y1)).astype(int).tolist(), np.floor(x1 + t * (x2 - x1)).astype(int).tolist()))
        inside = {(r, c) for r, c in seen if 0 <= r < 20 and 0 <= c < 20}
        mine = {(r, c) for k, r, c in got if k == i}
        assert inside <= mine and len(mine - inside) <= 2  # a corner that the samples step over


def test_road_distances_from_lines(spark):
    cells = spark.createDataFrame([(r, c) for r in range(12) for c in range(15)], "r int, c int")
    lines = spark.createDataFrame([(1, 1000.0 + 100 * 2.5, 5000.0 - 100 * 1.5, 1000.0 + 100 * 2.5, 5000.0 - 100 * 9.5)], "id int, x1 double, y1 double, x2 double, y2 double")
    got = {(r.r, r.c): r.road_distance_km for r in drivers.roads_from_lines(cells, lines, 1000.0, 5000.0, 100.0, 12, 15).collect()}
    for (r, c), d in got.items():
        assert d == pytest.approx(min(math.hypot(r - k, c - 2) for k in range(1, 10)))


def test_years_of_a_bucketed_map_meet_without_an_exchange(spark):
    rows = [(p, y, p % 5 + (y == 2010), 60 + p % 40) for p in range(300) for y in (2000, 2005, 2010, 2020)]
    name = bucketed.write(spark.createDataFrame(rows, "pix int, year int, class int, conf int"), "pix", 4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs = bucketed.year_pairs(spark, name)
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert pairs.count() == 600 and pairs.where("from_year = 2005 AND to_class <> from_class").count() == 300
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql(f"DROP TABLE {name}")


def test_a_run_makes_only_what_is_stale(spark, tmp_path):
    rows = [(p, y, k % 4, float(k)) for p in ("a", "b") for y in (2000, 2005) for k in range(20)]
    df = lambda rs: spark.createDataFrame(rs, "product string, year int, class int, v double")
    seen = []

    def make(d):
        seen.append(sorted(tuple(x) for x in d.select("product", "year").distinct().collect()))
        return d.groupBy("product", "year", "class").agg(F.sum("v").alias("total"))

    go = lambda d, s=None, **k: manifest.refresh(spark, f"{tmp_path}/m", "sum", d, make, f"{tmp_path}/out", s or {"x": 1}, **k)
    every = [("a", 2000), ("a", 2005), ("b", 2000), ("b", 2005)]
    assert go(df(rows)) == every
    assert go(df(rows[::-1])) == [] and len(seen) == 1  # the order of rows doesn't matter
    changed = [(p, y, c, v + (p == "b")) for p, y, c, v in rows]
    assert go(df(changed)) == [("b", 2000), ("b", 2005)] and seen[-1] == [("b", 2000), ("b", 2005)]
    out = {(r["product"], r.year): r.t for r in spark.read.parquet(f"{tmp_path}/out").groupBy("product", "year").agg(F.sum("total").alias("t")).collect()}
    assert out == {("a", 2000): 190.0, ("a", 2005): 190.0, ("b", 2000): 210.0, ("b", 2005): 210.0}
    assert go(df(changed), {"x": 2}) == every  # other settings
    assert go(df(changed), {"x": 2}, force=True) == every
    assert go(df(changed + changed[:1]), {"x": 2}) == [("a", 2000)]  # a repeated row is another input
    assert go(df(rows), {"x": 1}) == every  # what was made before, but not last
    fewer = manifest.digests(df([r for r in rows if r[0] == "a"]), "sum", {"x": 1})
    assert {(r["product"], r.year) for r in manifest.gone(manifest.entries(spark, f"{tmp_path}/m"), fewer, "sum").collect()} == {("b", 2000), ("b", 2005)}


def test_steps_read_what_the_steps_before_wrote(spark, tmp_path):
    rows = spark.createDataFrame([("a", 2000, 1), ("a", 2005, 2)], "product string, year int, v int")
    steps = [("one", lambda: rows, lambda d: d.withColumn("v", F.col("v") * 10), f"{tmp_path}/one", {}), ("two", lambda: spark.read.parquet(f"{tmp_path}/one"), lambda d: d.withColumn("v", F.col("v") + 1), f"{tmp_path}/two", {})]
    assert manifest.run(spark, f"{tmp_path}/m", steps) == {"one": [("a", 2000), ("a", 2005)], "two": [("a", 2000), ("a", 2005)]}
    assert sorted(r.v for r in spark.read.parquet(f"{tmp_path}/two").collect()) == [11, 21]
    assert manifest.run(spark, f"{tmp_path}/m", steps) == {"one": [], "two": []}


def test_permuting_a_planted_feature_costs_accuracy(spark):
    rng = np.random.default_rng(5)
    rows = [(i, float(a), float(b), int(a > 0)) for i, (a, b) in enumerate(rng.normal(size=(600, 2)))]
    df = spark.createDataFrame(rows, "id long, a double, b double, y int")
    variants = evaluate.permuted(df, "id", ["a", "b"]).collect()
    assert len(variants) == 1800
    for c in ("a", "b"):
        own = [r for r in variants if r.permuted == c]
        held = {r[0]: r for r in rows}
        assert sorted(r[c] for r in own) == sorted(r[1 if c == "a" else 2] for r in rows)
        assert all(r["b" if c == "a" else "a"] == held[r.id][2 if c == "a" else 1] for r in own)
        assert sum(r[c] == held[r.id][1 if c == "a" else 2] for r in own) < 20
    calls = []

    def predicted(d):
        calls.append(1)
        return d.withColumn("predicted", (F.col("a") > 0).cast("int"))

    got = {r.feature: r for r in evaluate.permutation_importance(df, "id", ["a", "b"], "y", predicted).collect()}
    assert len(calls) == 1 and got["b"].importance == 0 and 0.4 < got["a"].importance < 0.6


def test_accuracy_by_area_on_a_published_example(spark):
    """Olofsson et al. 2014, table 8: overall 0.95, users' 0.88 0.73 0.93 0.96, producers' 0.75 0.85 0.93 0.96; area of the first 235,086 and its interval 68,418."""
    counts = [[66, 0, 5, 4], [0, 55, 8, 12], [1, 0, 153, 11], [2, 1, 9, 313]]
    matrix = spark.createDataFrame([(i, j, n) for i, row in enumerate(counts) for j, n in enumerate(row) if n], "mapped int, reference int, n long")
    areas = spark.createDataFrame(list(enumerate([200_000.0, 150_000.0, 3_200_000.0, 6_450_000.0])), "class int, area double")
    one = evaluate.area_weighted_overall(matrix, areas).first()
    assert round(one.accuracy, 3) == 0.947 and round(1.96 * one.se, 3) == 0.018 and one.high - one.low == pytest.approx(3.92 * one.se)
    got = {r["class"]: r for r in evaluate.area_weighted_accuracy(matrix, areas).collect()}
    assert [round(got[k].user, 2) for k in range(4)] == [0.88, 0.73, 0.93, 0.96]
    assert [round(1.96 * got[k].user_se, 2) for k in range(4)] == [0.07, 0.10, 0.04, 0.02]
    assert [round(got[k].producer, 2) for k in range(4)] == [0.75, 0.85, 0.93, 0.96]
    n, w = np.array(counts, float), np.array([200_000, 150_000, 3_200_000, 6_450_000]) / 1e7
    m = n.sum(axis=1)
    for k in range(4):  # the estimator's variance once more, with the strata as loops
        share = sum(w[i] * n[i, k] / m[i] for i in range(4))
        right = w[k] * n[k, k] / m[k] / share
        own = (w[k] * (1 - right)) ** 2 * n[k, k] / m[k] * (1 - n[k, k] / m[k]) / (m[k] - 1)
        other = right**2 * sum(w[i] ** 2 * n[i, k] / m[i] * (1 - n[i, k] / m[i]) / (m[i] - 1) for i in range(4) if i != k)
        assert got[k].producer_se == pytest.approx(math.sqrt(own + other) / share)
    assert round(got[0].area) == 235086 and round(1.96 * got[0].area_se) == 68418 and sum(r.area for r in got.values()) == pytest.approx(10_000_000)


def test_permuting_shuffles_rows_once_and_predicts_them_once(spark, monkeypatch):
    monkeypatch.setattr(evaluate, "LOT", 100)
    df = spark.range(1000).select("id", (F.col("id") * 1.0).alias("a"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("b"), (F.col("id") % 3).cast("int").alias("y"), (F.col("id") % 5).alias("fold"))
    made = evaluate.permuted(df, "id", ["a", "b"], "y", "fold")
    rows = made.collect()
    assert len(rows) == 3000 and all(r.y == r.id % 3 and r.fold == r.id % 5 for r in rows)
    for c in (None, "a", "b"):
        own = [r for r in rows if r.permuted == c]
        assert sorted(r.id for r in own) == sorted(int(r.a) for r in own) == list(range(1000))
        assert sorted(r.b for r in own if r.b is not None) == list(range(0, 1000, 2)) and sum(r.b is None for r in own) == 500
        assert sum(r.a == r.id for r in own) == (0 if c == "a" else 1000)
    assert sorted(map(str, rows)) == sorted(map(str, evaluate.permuted(df.repartition(7), "id", ["a", "b"], "y", "fold").collect()))
    seen = spark.sparkContext.accumulator(0)

    def predicted(d):
        def run(batches):
            for b in batches:
                seen.add(len(b))
                yield b.assign(predicted=(b["a"] % 3).astype("int32"))

        return d.mapInPandas(run, ", ".join(f"{c} {t}" for c, t in d.dtypes) + ", predicted int")

    got = evaluate.permutation_importance(df, "id", ["a", "b"], "y", predicted, "fold")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(_h") == 1 and "Join" not in plan
    by = {r.feature: r for r in got.collect()}
    assert seen.value == 3000 and by["b"].importance == 0 and 0.5 < by["a"].importance < 0.8

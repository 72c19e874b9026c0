"""What a step costs must not grow faster than its input."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoweave.operators import boosting, fusion, grid
from geoweave.plans.queries import QUERIES
from geoweave.plans.views import spark_view
from geoweave.sources import catalog


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString().lower()


def test_distances_take_one_step_a_row_of_a_tall_column(spark):
    rng = np.random.default_rng(5)
    cells = spark.createDataFrame([(r, c) for r in range(300) for c in range(3)], "r int, c int")
    marked = sorted({(int(r), int(c)) for r, c in zip(rng.integers(0, 300, 12), rng.integers(0, 2, 12))})
    roads = spark.createDataFrame(marked, "r int, c int")
    found = grid.distance_squared(cells, roads, 300, 3)
    assert {(x.r, x.c): x.d2 for x in found.collect()} == {(r, c): min((r - a) ** 2 + (c - b) ** 2 for a, b in marked) for r in range(300) for c in range(3)}
    plan = plan_of(found)
    assert "unboundedpreceding$(), currentrow$()" in plan
    assert "unboundedfollowing" not in plan  # Spark computes such a frame from its end for every row: the square of a column
    assert {x.d2 for x in grid.distance_squared(cells, roads.where(F.lit(False)), 300, 3).collect()} == {None}


def test_boosting_reads_rows_of_equal_bins_once(spark):
    rng = np.random.default_rng(6)
    distinct = [(float(x), float(y)) for x in range(4) for y in range(3)]
    picked = rng.integers(len(distinct), size=3000)
    data = [(i, *distinct[k], int((k + (rng.random() < 0.2)) % 3), i % 2) for i, k in enumerate(picked.tolist())]
    df = spark.createDataFrame(data, "id long, x double, y double, label int, fold int")
    s = boosting.Settings(rounds=2, depth=2, rate=0.3)
    model = boosting.fit(df.repartition(3), ["x", "y"], "label", "id", fold="fold", held_out=[0, 1], bins=8, settings=s)
    step = boosting._Pass([0, 1], 3, 2, s)
    table = boosting.prepared(df, ["x", "y"], "label", "id", "fold", model.edges, model.classes, step)
    packs = table.select("bins", "counts", F.length("keys").alias("bytes")).collect()
    # As many packs as there are different bins, full packs and ends of tasks; not as many as there are rows.
    assert len(packs) <= len(distinct) + len(data) // boosting.PACK + 8 * len(distinct)
    assert sum(p.bytes for p in packs) == 8 * len(data) and len({bytes(p.bins) for p in packs}) == len(distinct)
    # A pack counts the rows that each model learns from.
    key, fold = (np.array([r[0] for r in df.select(c).orderBy("id").collect()]) for c in (F.xxhash64("id"), "fold"))
    drawn = boosting._mixed(key, s.seed * 31 + 7919) < s.rows
    want = [int((step.learns(m, key, fold)[0] & drawn).sum()) for m in (0, 1)]
    assert np.sum([np.frombuffer(bytes(p.counts), np.int32).reshape(2, 3).sum(axis=1) for p in packs], axis=0).tolist() == want


def test_votes_are_dealt_before_they_are_multiplied(spark):
    plan = spark_view(spark, "/root/testdata/sf0.001", "v_votes")._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
    assert len(dealt) == 2 and all("orderkey" in line and "year" not in line for line in dealt)


def test_class_areas_fuse_a_cell_once(spark):
    fused = spark.range(60).selectExpr("CAST(id % 2 AS INT) AS year", "CAST(id % 3 AS INT) AS fused", "CAST(id % 50 AS INT) AS conf_joint", "CAST(id % 4 AS INT) AS agreement")
    out = fusion.class_area(fused)
    assert plan_of(out).count("range (0, 60") == 1
    assert {(r.year, r["class"]): (r.n, r.area_pct) for r in out.collect()} == {(y, k): (10, 33.333) for y in (0, 1) for k in (0, 1, 2)}


@pytest.mark.parametrize(("name", "held"), [("manifest_runs", "inputs"), ("spillover_gap", "neighbours")])
def test_what_is_read_several_times_is_made_once(spark, monkeypatch, name, held):
    made, stored = [], catalog.stored
    monkeypatch.setattr(catalog, "stored", lambda df, n: made.append(n) or stored(df, n))
    assert QUERIES[name](spark, "/root/testdata/sf0.01").count() > 0
    assert made == [held]


def test_votes_are_those_of_their_sql(spark):
    from geoweave.plans import views

    folder = "/root/testdata/sf0.001"
    tables = {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in ("lineitem", "orders")}
    odd = tables["lineitem"].withColumn("l_linenumber", F.when(F.col("l_orderkey") % 50 == 0, F.lit(9)).when(F.col("l_orderkey") % 50 == 1, F.lit(1)).otherwise(F.col("l_linenumber")).cast(tables["lineitem"].schema["l_linenumber"].dataType))
    odd = odd.withColumn("l_quantity", F.when(F.col("l_orderkey") % 31 == 0, F.lit(None)).otherwise(F.col("l_quantity"))).withColumn("l_partkey", F.when(F.col("l_orderkey") % 37 == 0, -F.col("l_partkey")).otherwise(F.col("l_partkey")))
    for lines in (tables["lineitem"], odd):
        needs = {n: spark_view(spark, folder, n) for n in ("v_anchor", "v_code_counts", "v_available", "v_codes")}
        want = spark.sql(views.VIEWS["v_votes"], lineitem=lines, orders=tables["orders"], **needs)
        got = views._votes(lines, tables["orders"])
        assert got.dtypes == want.dtypes
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert plan_of(got).count("join") == 0  # codes are looked up, and a line is grouped once for all years


@pytest.mark.parametrize("name", ["feature_table_wide", "driver_drought_values", "driver_vegetation"])
def test_wide_groups_are_dealt_by_number(spark, name):
    """Adaptive execution joins partitions by their bytes, one for each core, whatever their groups take; a dealt table keeps its tasks."""
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan


def test_tasks_grow_with_the_table(spark):
    from geoweave.plans.views import tasks

    assert tasks(spark.range(100), 10) == 11 and tasks(spark.range(10), 10) == 4


def test_windows_are_packed_into_lots_that_rounds_read(spark):
    from geoweave.operators import networks

    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 2))
    rows = spark.createDataFrame([(float(a), float(b), float(a - b), bool(i % 5 == 0)) for i, (a, b) in enumerate(x)], "x_2 double, x_1 double, _y double, _judged boolean")
    lots = networks.packed(rows.repartition(2), ["x_2", "x_1"], 64).collect()
    assert len(lots) <= 700 // 64 + 4  # not a row for each window; ends of two tasks
    for away in (False, True):
        got = np.concatenate([np.frombuffer(r.data).reshape(-1, 3) for r in lots if r.judged == away])
        want = [(a, b, a - b) for i, (a, b) in enumerate(x) if (i % 5 == 0) == away]
        assert sorted(map(tuple, got.tolist())) == sorted((float(a), float(b), float(c)) for a, b, c in want)
    assert networks.packed(rows.where(F.lit(False)), ["x_2", "x_1"]).count() == 0

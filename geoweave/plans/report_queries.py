"""Queries of reports, samples, and of tables written to the shared folder and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoweave.operators import evaluate, features, grid, harmonize, reports
from geoweave.plans.registry import query
from geoweave.sources import catalog


@query("""SELECT product_id, native, n, round_even(100.0::DOUBLE * n / sum(n) OVER (PARTITION BY product_id), 2) AS pct, CAST(row_number() OVER (PARTITION BY product_id ORDER BY n DESC, native) AS INT) AS rank
FROM (SELECT product_id, native, count(*) AS n FROM v_votes GROUP BY 1, 2)""")
def product_histogram(spark, view):
    """Codes of each product with their shares, halves rounded to even."""
    return harmonize.histogram_shares(view("v_votes"), "native", "product_id")


@query("SELECT class, n FROM (SELECT class, count(*) AS n FROM v_map WHERE year = 2020 GROUP BY 1) ORDER BY n DESC, class LIMIT 8")
def top_classes(spark, view):
    return harmonize.most_frequent(view("v_map").where("year = 2020"), 8, "class")


@query("SELECT from_class, to_class, n FROM (SELECT from_class, to_class, sum(n)::BIGINT AS n FROM v_transitions WHERE from_class <> to_class GROUP BY 1, 2) ORDER BY n DESC, from_class, to_class LIMIT 10")
def top_transitions(spark, view):
    return harmonize.most_frequent(view("v_pairs").where("from_class > 0 AND to_class > 0 AND from_class <> to_class"), 10, "from_class", "to_class")


@query("SELECT pix, class, coalesce(class = 8, false) AS is_water, CASE WHEN coalesce(class = 8, false) THEN NULL ELSE CAST(conf AS DOUBLE) END AS value FROM v_map WHERE year = 2015")
def water_flagged(spark, view):
    m = view("v_map").where("year = 2015").select("pix", "class", F.col("conf").cast("double").alias("value"))
    return reports.without_water(m, "class", "value", (8,)).select("pix", "class", "is_water", "value")


@query("SELECT node, round(least(value, c), 10) AS shown FROM v_nodes, (SELECT quantile_cont(value, 0.99) AS c FROM v_nodes)")
def display_capped(spark, view):
    return reports.display_cap(view("v_nodes"), "value").select("node", F.round("shown", 10).alias("shown"))


@query("SELECT br, round(avg(value), 10) AS mean, round(median(value), 10) AS median FROM v_nodes GROUP BY 1")
def node_centre(spark, view):
    return reports.centre(view("v_nodes"), "value", "br").select("br", F.round("mean", 10).alias("mean"), F.round("median", 10).alias("median"))


@query("SELECT l AS \"limit\", count(*) FILTER (value > l) AS n, round(100.0::DOUBLE * count(*) FILTER (value > l) / count(*), 4) AS pct FROM v_nodes CROSS JOIN (VALUES (1.0::DOUBLE), (1.5::DOUBLE), (2.0::DOUBLE)) t(l) GROUP BY 1")
def shares_over_limits(spark, view):
    return reports.shares_over(view("v_nodes"), "value", (1.0, 1.5, 2.0))


_PHI = "SELECT label AS class, avg(abs(CAST(embedding[{0}] AS DOUBLE))) AS m FROM embeddings WHERE embedding[{0}] {1} 0 GROUP BY 1"


@query(f"SELECT coalesce(a.class, b.class) AS class, round(coalesce(a.m, 0), 8) AS a, round(coalesce(b.m, 0), 8) AS b FROM ({_PHI.format(1, '>')}) a FULL JOIN ({_PHI.format(2, '<')}) b ON b.class = a.class")
def attribution_side_by_side(spark, view):
    """Mean attributions of two sets of rows by class: those whose first component is positive, and those whose second is negative."""
    mean = lambda i, kept: view("embeddings").where(kept(F.col("embedding")[i])).groupBy(F.col("label").alias("class")).agg(F.avg(F.abs(F.col("embedding")[i].cast("double"))).alias("m"))
    out = reports.side_by_side(mean(0, lambda v: v > 0), mean(1, lambda v: v < 0), ["class"], "m")
    return out.select("class", F.round("a", 8).alias("a"), F.round("b", 8).alias("b"))


@query("SELECT CAST(i AS INT) AS step, round(avg(CAST(embedding[i + 1] AS DOUBLE)), 8) AS mean_weight, count(*) AS n FROM embeddings CROSS JOIN range(3) t(i) GROUP BY 1")
def attention_steps(spark, view):
    steps = F.array(*(F.struct(F.lit(i).alias("step"), F.col("embedding")[i].cast("double").alias("weight")) for i in range(3)))
    return reports.attention_by_step(view("embeddings").select(F.inline(steps))).withColumn("mean_weight", F.round("mean_weight", 8))


@query("""SELECT n_nationkey AS id, substr(sha1('{"cap":' || CAST(n_regionkey AS VARCHAR) || ',"name":"' || n_name || '","year":2020}'), 1, 10) AS digest FROM nation""")
def run_digest(spark, view):
    n = view("nation")
    return n.select(F.col("n_nationkey").alias("id"), reports.digest(year=F.lit(2020), name=F.col("n_name"), cap=F.col("n_regionkey")).alias("digest"))


@query("""SELECT n_nationkey AS name, '<Placemark><name>' || CAST(n_nationkey AS VARCHAR) || '</name><description>' || n_name || ' &amp; &lt;' || CAST(n_regionkey AS VARCHAR) || '&gt;</description><Point><coordinates>' || printf('%.6f,%.6f,0', 80 + n_nationkey * 1.25::DOUBLE, 30 + n_regionkey * 0.5::DOUBLE) || '</coordinates></Point></Placemark>' AS kml FROM nation""")
def point_placemarks(spark, view):
    n = view("nation").select(F.col("n_nationkey").alias("id"), (F.lit(80.0) + F.col("n_nationkey") * F.lit(1.25)).alias("lon"), (F.lit(30.0) + F.col("n_regionkey") * F.lit(0.5)).alias("lat"), F.concat("n_name", F.lit(" & <"), F.col("n_regionkey").cast("string"), F.lit(">")).alias("text"))
    return reports.placemarks(n, "id", "lon", "lat", "text")


@query("""SELECT t.*, count(p.pix) AS n_here, CAST(count(DISTINCT p.to_class) AS INT) AS classes_here
FROM (VALUES ('A', 'confidence 80 or more at both ends', CAST(3240000 AS BIGINT), 12, 82.2::DOUBLE, 0.597::DOUBLE, 0.813::DOUBLE), ('B', 'all pixels', 4590000, 13, 77.8, 0.6, 0.772)) t(training_set, rows_used, n_rows, n_classes, accuracy_pct, macro_f1, weighted_f1)
LEFT JOIN (SELECT * FROM v_pairs WHERE from_class > 0 AND to_class > 0) p ON t.training_set = 'B' OR p.conf_from >= 80 AND p.conf_to >= 80 GROUP BY ALL""")
def published_results(spark, view):
    """The published figures of both training sets beside the rows and classes that the same rules give here."""
    pairs = view("v_pairs").where("from_class > 0 AND to_class > 0")
    sets = F.explode(F.when((F.col("conf_from") >= 80) & (F.col("conf_to") >= 80), F.array(F.lit("A"), F.lit("B"))).otherwise(F.array(F.lit("B"))))
    here = pairs.select(sets.alias("training_set"), "to_class").groupBy("training_set").agg(F.count("*").alias("n_here"), F.countDistinct("to_class").cast("int").alias("classes_here"))
    return reports.published(spark).join(here, "training_set", "left").na.fill(0, ["n_here", "classes_here"])


# -- Samples by integer draws.

_DRAW = "((42 * 31 + {0} * 7919 + 12345) % 1000003 * 48271) % 1000003"


@query(f"SELECT pix, {_DRAW.format('pix')} < greatest(0.1::DOUBLE, least(1.0, 5000.0::DOUBLE / (SELECT count(*) FROM v_aoi))) * 1000003 AS held FROM v_aoi")
def validation_split(spark, view):
    return evaluate.held_out(view("v_aoi"), "pix").select("pix", "held")


@query(f"SELECT pix, CAST({_DRAW.format('pix')} % 5 AS INT) AS fold FROM v_aoi")
def random_folds(spark, view):
    return evaluate.random_folds(view("v_aoi"), "pix").select("pix", "fold")


@query("""WITH c AS (SELECT from_class, to_class, count(*) AS n FROM v_pairs WHERE from_class > 0 AND to_class > 0 GROUP BY 1, 2), q AS (SELECT *, least(n, CAST(round_even(round(ln(1 + n) / (SELECT sum(ln(1 + n)) FROM c) * 500, 9), 0) AS BIGINT)) AS quota FROM c),
r AS (SELECT p.from_class, p.to_class, p.pix * 10000 + p.from_year AS id, row_number() OVER (PARTITION BY p.from_class, p.to_class ORDER BY ((42 * 31 + (p.pix * 10000 + p.from_year) * 7919 + 12345) % 1000003 * 48271) % 1000003, p.pix * 10000 + p.from_year) AS k FROM v_pairs p WHERE from_class > 0 AND to_class > 0)
SELECT r.from_class AS from_class, r.to_class AS to_class, id FROM r JOIN q ON q.from_class = r.from_class AND q.to_class = r.to_class WHERE k <= quota""")
def log_quota_rows(spark, view):
    rows = view("v_pairs").where("from_class > 0 AND to_class > 0").select("from_class", "to_class", (F.col("pix") * 10000 + F.col("from_year")).alias("id"))
    keys = ["from_class", "to_class"]
    return evaluate.quota_sample(rows, evaluate.log_quotas(rows, keys, 500), keys, "id")


@query("SELECT r, c, value FROM v_cells WHERE r * 125 + c IN (SELECT pix FROM v_aoi)")
def area_mask(spark, view):
    inside = view("v_grid").join(view("v_aoi"), "pix")
    return grid.within(view("v_cells"), inside, "r", "c").select("r", "c", "value")


@query("SELECT o_orderkey AS pix, CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderkey % 50 AS DOUBLE) END AS value FROM orders")
def no_data_to_null(spark, view):
    k = F.col("o_orderkey")
    raw = F.when(k % 11 == 0, F.lit(3.4e38)).when(k % 13 == 0, F.lit(float("nan"))).when(k % 17 == 0, F.lit(float("-inf"))).when(k % 7 == 0, F.lit(-99999.0)).otherwise((k % 50).cast("double"))
    return view("orders").select(k.alias("pix"), features.no_data(raw, -99999).alias("value"))


# -- Scans and sinks.


@query("SELECT o_orderkey AS key, o_orderstatus AS status FROM orders WHERE o_orderstatus IN ('F', 'P')", paths=True)
def projected_scan(spark, view, sf_dir):
    """Two of the columns of a Parquet table, with a pushed filter."""
    return catalog.read_pixels(spark, f"{sf_dir}/orders.parquet", columns=("o_orderkey", "o_orderstatus"), o_orderstatus=["F", "P"]).toDF("key", "status")


@query("SELECT pix, year, value FROM v_driver WHERE variable = 'CDD' AND year BETWEEN 1995 AND 2004")
def driver_stack(spark, view):
    """The yearly layers of one variable in a range, those that exist."""
    return catalog.years_between(view("v_driver"), "CDD", 1995, 2004).select("pix", "year", "value")


@query("SELECT DISTINCT variable, year FROM v_driver")
def available_years(spark, view):
    return catalog.available_years(view("v_driver"), "variable")


@query("SELECT pix, year, class, conf FROM v_map WHERE year IN (2005, 2015)", paths=True)
def pixel_round_trip(spark, view, sf_dir):
    """Pixels written by year with zstandard, and two years of them read again: only their folders are."""
    path = f"{catalog.scratch(spark)}/pixels"
    catalog.write_pixels(view("v_map"), path)
    return catalog.read_pixels(spark, path, columns=("pix", "year", "class", "conf"), year=[2005, 2015])


@query("SELECT zone, t, round(ndvi, 9) AS ndvi FROM v_series", paths=True)
def csv_round_trip(spark, view, sf_dir):
    path = f"{catalog.scratch(spark)}/series-csv"
    catalog.write_csv(view("v_series").select("zone", "t", F.round("ndvi", 9).alias("ndvi")), path)
    return catalog.read_csv(spark, path, "zone string, t int, ndvi double")


@query("SELECT node, br, bc, round(value, 10) AS value FROM v_nodes", paths=True)
def json_round_trip(spark, view, sf_dir):
    path = f"{catalog.scratch(spark)}/nodes-json"
    catalog.write_json(view("v_nodes").select("node", "br", "bc", F.round("value", 10).alias("value")), path)
    return spark.read.schema("node int, br int, bc int, value double").json(path)


@query("SELECT pixel AS cell, CAST(year AS INT) AS year, CAST(month AS INT) AS month, z AS value FROM v_monthly WHERE year BETWEEN 1993 AND 1995")
def monthly_open(spark, view):
    """A monthly table under other names of its dimensions, opened by the first name that it has."""
    raw = view("v_monthly").select(F.col("pixel").alias("location"), F.make_date("year", "month", F.lit(1)).alias("Time"), F.col("z").alias("SPEI"))
    named = catalog.resolved(raw, {"cell": ("cell", "pixel", "location"), "time": ("time", "date"), "value": ("spei", "value")})
    return named.select("cell", F.year("time").alias("year"), F.month("time").alias("month"), "value").where("year BETWEEN 1993 AND 1995")


@query("SELECT product, y AS year, '/data/' || lower(product) || '_' || CAST(y AS VARCHAR) || CASE WHEN y < 1996 THEN '.tif' ELSE '_v2.tif' END AS path FROM (SELECT n_name AS product, CAST(1990 + n_nationkey AS INT) AS y FROM nation)")
def file_catalog(spark, view):
    """Of the files that name a year, the best for each product."""
    n, y = view("nation"), F.lit(1990) + F.col("n_nationkey")
    stem = F.concat(F.lit("/data/"), F.lower("n_name"), F.lit("_"), y.cast("string"))
    rows = [F.struct(F.concat(stem, F.lit(".tif")).alias("path"), F.when(y < 1996, 1).otherwise(3).alias("priority")), F.struct(F.concat(stem, F.lit("_v2.tif")).alias("path"), F.lit(2).alias("priority")), F.struct(F.lit("/data/readme.txt").alias("path"), F.lit(0).alias("priority"))]
    files = catalog.file_years(n.select(F.col("n_name").alias("product"), F.inline(F.array(*rows))))
    return catalog.catalog(files).select("product", "year", "path")

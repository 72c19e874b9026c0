"""Queries of features, grids, stencils and drivers."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoweave.functions.expressions import Albers, aspect_cos, aspect_sin
from geoweave.operators import drivers, features, grid
from geoweave.plans.driver_queries import _TARGET
from geoweave.plans.registry import ORACLES, query
from geoweave.plans.views import tasks

_W, _H = 125, 120


def _height(view) -> int:
    return int(view("v_grid").agg(F.max("r")).first()[0]) + 1


@query("""SELECT target, source_year FROM (SELECT t.year AS target, a.year AS source_year, row_number() OVER (PARTITION BY t.year ORDER BY abs(a.year - t.year), a.year) AS rn
FROM (SELECT CAST(1988 + range * 3 AS INT) AS year FROM range(13)) t CROSS JOIN (SELECT year FROM v_annual UNION SELECT year FROM v_anchor) a) WHERE rn = 1""")
def nearest_year_asof(spark, view):
    targets = spark.range(13).select((F.col("id") * 3 + 1988).cast("int").alias("year"))
    return features.nearest_year(targets, view("v_annual").select("year").union(view("v_anchor").select("year")))


def _slope_sql(years: int, least: int, listed: int) -> str:
    return f"""SELECT a.entity AS entity, a.year AS year, CASE WHEN count(b.value) >= {least} AND count(*) >= {listed} THEN round(regr_slope(b.value, CAST(b.year AS DOUBLE)), 4) END AS slope
FROM v_annual a JOIN v_annual b ON b.entity = a.entity AND b.year BETWEEN a.year - {years - 1} AND a.year GROUP BY a.entity, a.year"""


@query(_slope_sql(5, 3, 3))
def trailing_slope_5y(spark, view):
    return features.trailing_slope(view("v_annual"), "entity", "year", "value", 5, 3, 3).select("entity", "year", F.round("slope", 4).alias("slope"))


@query(_slope_sql(10, 3, 5))
def trailing_slope_10y(spark, view):
    return features.trailing_slope(view("v_annual"), "entity", "year", "value", 10, 3, 5).select("entity", "year", F.round("slope", 4).alias("slope"))


@query("""SELECT a.entity AS entity, a.year AS year, CASE WHEN b.n >= 3 THEN round(a.value - b.m, 4) END AS anomaly FROM v_annual a
LEFT JOIN (SELECT entity, count(value) AS n, avg(value) AS m FROM v_annual WHERE year BETWEEN 1996 AND 1999 GROUP BY entity) b ON b.entity = a.entity""")
def baseline_anomaly(spark, view):
    return features.anomaly(view("v_annual"), "entity", "year", "value", 1996, 1999, 3).select("entity", "year", F.round("anomaly", 4).alias("anomaly"))


@query("""SELECT pixel, year, round(avg(z), 12) AS annual_mean, round(coalesce(avg(z) FILTER (month BETWEEN 4 AND 9), avg(z)), 12) AS gs_mean, round(min(z), 12) AS min, round(max(z), 12) AS max,
count(*) FILTER (z < -1.5) AS n_severe_drought, count(*) FILTER (z >= -1.5 AND z < -1.0) AS n_moderate_drought, count(*) FILTER (z > 1.5) AS n_wet FROM v_monthly GROUP BY 1, 2""")
def drought_yearly_stats(spark, view):
    s = features.yearly_statistics(view("v_monthly"), ("pixel", "year"))
    return s.select("pixel", "year", *(F.round(c, 12).alias(c) for c in ("annual_mean", "gs_mean", "min", "max")), "n_severe_drought", "n_moderate_drought", "n_wet")


@query("""SELECT variable, count(*) - count(v) AS n_null, round(avg(v), 6) AS mean FROM (SELECT variable, CASE WHEN variable = 'Rx1day' AND value BETWEEN 0 AND 1000 THEN value WHEN variable = 'Tn10p' AND value BETWEEN -1 AND 101 THEN value
WHEN variable = 'other' THEN value END AS v FROM (SELECT CASE l_linenumber % 3 WHEN 0 THEN 'Rx1day' WHEN 1 THEN 'Tn10p' ELSE 'other' END AS variable, l_quantity * 25 AS value FROM lineitem)) GROUP BY 1""")
def plausibility_clamp(spark, view):
    from geoweave.functions import dims

    n = F.col("l_linenumber") % 3
    long = view("lineitem").select(F.when(n == 0, "Rx1day").when(n == 1, "Tn10p").otherwise("other").alias("variable"), (F.col("l_quantity") * 25).alias("value"))
    out = features.clamp_table(long, dims.PLAUSIBLE)
    return out.groupBy("variable").agg((F.count("*") - F.count("value")).alias("n_null"), F.round(F.avg("value"), 6).alias("mean"))


@query("SELECT p_partkey AS pix, CASE WHEN p_size <> 7 THEN round(p_size * 0.0001::DOUBLE, 8) END AS value FROM part")
def fixed_point_scale(spark, view):
    return view("part").select(F.col("p_partkey").alias("pix"), F.round(features.scale_fixed_point(F.col("p_size"), nodata=7), 8).alias("value"))


@query("SELECT pix, round(sin(radians(CAST(pix % 360 AS DOUBLE))), 9) + 0.0 AS aspect_sin, round(cos(radians(CAST(pix % 360 AS DOUBLE))), 9) + 0.0 AS aspect_cos FROM v_grid")
def aspect_components(spark, view):
    angle = (F.col("pix") % 360).cast("double")
    return view("v_grid").select("pix", (F.round(aspect_sin(angle), 9) + 0.0).alias("aspect_sin"), (F.round(aspect_cos(angle), 9) + 0.0).alias("aspect_cos"))


def _albers_sql() -> str:
    a = Albers()
    p2, p4, p6 = a.series
    return f"""SELECT pix, round(degrees(atan2(x, dy) / {a.n!r}) + {a.lon0!r}, 7) AS lon, round(degrees(beta + sin(beta * 2) * {p2!r} + sin(beta * 4) * {p4!r} + sin(beta * 6) * {p6!r}), 7) AS lat
FROM (SELECT pix, x, dy, asin(({a.c!r} - (x * x + dy * dy) * {a.n**2 / a.a**2!r}) / {a.n!r} / {a.qp!r}) AS beta FROM (SELECT pix, x, {a.rho0!r} - y AS dy FROM v_grid))"""


@query(_albers_sql())
def albers_lonlat(spark, view):
    lon, lat = Albers().inverse(F.col("x"), F.col("y"))
    return view("v_grid").select("pix", F.round(lon, 7).alias("lon"), F.round(lat, 7).alias("lat"))


_REFLECT = "CASE WHEN {0} < 0 THEN -({0}) - 1 WHEN {0} >= {1} THEN 2 * {1} - 1 - ({0}) ELSE {0} END"


@query(f"""WITH h AS (SELECT max(r) + 1 AS h FROM v_grid), o AS (SELECT * FROM (VALUES (-1), (0), (1)) t(d)),
n AS (SELECT g.r, g.c, {_REFLECT.format("(g.r + i.d)", "h.h")} AS nr, {_REFLECT.format("(g.c + j.d)", _W)} AS nc FROM v_grid g CROSS JOIN h CROSS JOIN o i CROSS JOIN o j)
SELECT n.r AS r, n.c AS c, m.class AS class, count(*) AS n FROM n JOIN v_class2020 m ON m.r = n.nr AND m.c = n.nc WHERE m.class > 0 GROUP BY 1, 2, 3""")
def neighbourhood_fraction_3x3(spark, view):
    return grid.class_fractions(view("v_class2020").where("class > 0"), _height(view), _W, range(1, 15))


@query("""WITH g AS (SELECT * FROM v_gaps), f AS (SELECT a.r, a.c, sum(CAST(b.value AS DECIMAL(14,2))) AS s, count(*) AS n FROM g a JOIN g b ON b.r BETWEEN a.r - 3 AND a.r + 3 AND b.c BETWEEN a.c - 3 AND a.c + 3 AND b.value IS NOT NULL WHERE a.value IS NULL GROUP BY 1, 2)
SELECT g.r AS r, g.c AS c, round(coalesce(g.value, CASE WHEN f.n >= 5 THEN CAST(f.s AS DOUBLE) / f.n END), 4) AS value FROM g LEFT JOIN f ON f.r = g.r AND f.c = g.c""")
def gap_fill_7x7(spark, view):
    return grid.gap_fill(view("v_gaps")).select("r", "c", F.round("value", 4).alias("value"))


@query("""WITH g AS (SELECT * FROM v_gaps), o AS (SELECT * FROM (VALUES (-1), (0), (1)) t(d)), n AS (SELECT a.r, a.c, coalesce(b.value, 0) AS v FROM (SELECT g.r, g.c, g.r + i.d AS nr, g.c + j.d AS nc FROM g CROSS JOIN o i CROSS JOIN o j WHERE g.value IS NOT NULL) a LEFT JOIN g b ON b.r = a.nr AND b.c = a.nc)
SELECT r, c, round(median(v), 4) AS value FROM n GROUP BY 1, 2""")
def median_3x3(spark, view):
    return grid.median_filter(view("v_gaps")).select("r", "c", F.round("value", 4).alias("value"))


@query("""WITH h AS (SELECT (max(r) + 1) // 3 * 3 AS h FROM v_grid) SELECT br, bc, round(CAST(sum(CAST(value AS DECIMAL(14,2))) AS DOUBLE) / count(value), 4) AS value, count(value) AS n FROM v_blocks b, h WHERE b.r < h.h AND b.c < 123 GROUP BY 1, 2""")
def block_coarsen_mean(spark, view):
    return grid.coarsen_mean(view("v_cells"), 3, _height(view), _W).select("br", "bc", F.round("value", 4).alias("value"), "n")


@query("""WITH h AS (SELECT (max(r) + 1) // 3 * 3 AS h FROM v_grid), n AS (SELECT br, bc, class, count(*) AS n FROM v_blocks b, h WHERE b.r < h.h AND b.c < 123 GROUP BY 1, 2, 3)
SELECT br, bc, CAST(coalesce(first(class ORDER BY CASE WHEN class > 0 THEN n ELSE 0 END DESC, class) FILTER (class > 0), 0) AS INT) AS class FROM n GROUP BY 1, 2""")
def block_coarsen_mode(spark, view):
    return grid.coarsen_mode(view("v_cells"), 3, _height(view), _W)


@query("""WITH h AS (SELECT (max(r) + 1) // 3 * 3 AS h FROM v_grid), g AS (SELECT b.br, b.bc, b.class, v.value FROM v_blocks b JOIN v_gaps v ON v.r = b.r AND v.c = b.c, h WHERE b.r < h.h AND b.c < 123)
SELECT br, bc FROM g GROUP BY 1, 2 HAVING count(class) / 9.0 >= 0.5 AND count(value) / 9.0 >= 0.6""")
def node_mask(spark, view):
    cells = view("v_gaps").join(view("v_cells").select("r", "c", F.col("class").isNotNull().alias("inside")), ["r", "c"])
    return grid.node_mask(cells, 3, _height(view), _W, "inside", "value", 0.5, 0.6)


@query(f"SELECT t.r AS r, t.c AS c, coalesce(s.code, 0) AS code FROM ({_TARGET}) t LEFT JOIN v_raster s ON s.r = CAST(floor((t.r + 0.5) * 1.25) AS INT) AND s.c = CAST(floor((t.c + 0.5) * 1.75) AS INT)")
def resample_nearest(spark, view):
    target = grid.covering(spark, view("v_raster"), 1.25, 1.75)
    return grid.resample_nearest(view("v_raster"), target, 1.25, 1.75).withColumn("code", F.coalesce("code", F.lit(0)))


@query(f"""WITH t AS (SELECT r, c, (r + 0.5::DOUBLE) * 1.25 - 0.5 AS y, (c + 0.5::DOUBLE) * 1.75 - 0.5 AS x FROM ({_TARGET})), o AS (SELECT * FROM (VALUES (0), (1)) q(d)),
k AS (SELECT r, c, CAST(floor(y) AS INT) + i.d AS sr, CAST(floor(x) AS INT) + j.d AS sc, CASE i.d WHEN 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END * CASE j.d WHEN 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END AS w FROM t CROSS JOIN o i CROSS JOIN o j)
SELECT k.r AS r, k.c AS c, round(sum(w * value) / sum(CASE WHEN value IS NOT NULL THEN w END), 6) AS value FROM k LEFT JOIN v_raster s ON s.r = sr AND s.c = sc WHERE w > 0 GROUP BY 1, 2""")
def resample_bilinear(spark, view):
    target = grid.covering(spark, view("v_raster"), 1.25, 1.75)
    return grid.resample_bilinear(view("v_raster"), target, 1.25, 1.75).select("r", "c", F.round("value", 6).alias("value"))


@query("SELECT r, c, code FROM (SELECT g.r, g.c, code, row_number() OVER (PARTITION BY g.r, g.c ORDER BY seq DESC) AS rn FROM v_grid g JOIN v_rect p ON g.r >= r0 AND g.r < r1 AND g.c >= c0 AND g.c < c1) WHERE rn = 1")
def polygon_burn(spark, view):
    return grid.burn_rectangles(view("v_grid"), view("v_rect"))


@query("SELECT DISTINCT n_nationkey AS poly, g.r AS r, g.c AS c FROM v_grid g JOIN (SELECT n_nationkey, n_nationkey % 5 * 25 AS c0, n_nationkey // 5 * 24 AS r0 FROM nation) p ON g.r + 0.5 > r0 AND g.r + 0.5 < r0 + 10 AND g.c + 0.5 > c0 AND (g.c + 0.5 - c0) * 10 < 20 * (r0 + 10 - g.r - 0.5)")
def polygon_rasterise(spark, view):
    """Triangles burnt by the crossing parity of their edges."""
    n = view("nation").select(F.col("n_nationkey").alias("poly"), (F.col("n_nationkey") % 5 * 25).cast("double").alias("x"), (F.floor(F.col("n_nationkey") / 5) * 24).cast("double").alias("y"))
    x, y = F.col("x"), F.col("y")
    edge = lambda a, b, c, d: F.struct((x + a).alias("x1"), (y + b).alias("y1"), (x + c).alias("x2"), (y + d).alias("y2"))
    edges = n.select("poly", F.inline(F.array(edge(0, 0, 20, 0), edge(20, 0, 0, 10), edge(0, 10, 0, 0))))
    return grid.burn_polygons(view("v_grid"), edges)


@query("SELECT CAST(year(ts) AS INT) AS year, CAST(user_id % 120 AS INT) AS r, CAST(event_id % 125 AS INT) AS c, count(DISTINCT CAST(ts AS DATE)) AS n FROM events WHERE user_id IS NOT NULL GROUP BY 1, 2, 3 HAVING CAST(user_id % 120 AS INT) * 125 + CAST(event_id % 125 AS INT) IN (SELECT pix FROM v_grid)")
def event_day_count(spark, view):
    touched = view("events").select((F.col("user_id") % 120).cast("int").alias("r"), (F.col("event_id") % 125).cast("int").alias("c"), F.year("ts").alias("year"), F.to_date("ts").alias("day"))
    return drivers.sandstorms(view("v_grid"), touched).select("year", "r", "c", "n")


@query("SELECT g.r AS r, g.c AS c, min((g.r - w.r) * (g.r - w.r) + (g.c - w.c) * (g.c - w.c)) AS d2 FROM v_grid g CROSS JOIN v_roads w GROUP BY 1, 2")
def road_distance(spark, view):
    return grid.distance_squared(view("v_grid"), view("v_roads"), _height(view), _W).select("r", "c", F.col("d2").cast("int").alias("d2"))


@query("""SELECT a.pix AS pix, a.year AS year, a.class AS lulc_class, a.conf AS conf_joint, coalesce(p.class, 0) AS lulc_class_prev, coalesce(s.n, 0) AS n_months, round(s.m, 6) AS spei_annual_mean, round(sin(radians(CAST(a.pix % 360 AS DOUBLE))), 9) + 0.0 AS aspect_sin
FROM v_map a LEFT JOIN v_map p ON p.pix = a.pix AND p.year = a.year - 5 LEFT JOIN (SELECT pixel, year, count(*) AS n, avg(z) AS m FROM v_monthly GROUP BY 1, 2) s ON s.pixel = a.pix AND s.year = a.year""")
def feature_table(spark, view):
    cells = view("v_map").select("pix", "year", F.col("class").alias("lulc_class"), F.col("conf").alias("conf_joint"))
    before = view("v_map").select("pix", (F.col("year") + 5).alias("year"), F.col("class").alias("lulc_class_prev"))
    spei = view("v_monthly").groupBy(F.col("pixel").alias("pix"), "year").agg(F.count("*").alias("n_months"), F.round(F.avg("z"), 6).alias("spei_annual_mean"))
    aspect = view("v_grid").select("pix", (F.round(aspect_sin((F.col("pix") % 360).cast("double")), 9) + 0.0).alias("aspect_sin"))
    return features.feature_table(cells, [before, spei, aspect]).na.fill(0, ["lulc_class_prev", "n_months"])


_KINDS = "(VALUES ('pix', 'bigint', 'other'), ('year', 'int', 'geometry'), ('lulc_class', 'int', 'target'), ('conf_joint', 'int', 'target'), ('lulc_class_prev', 'int', 'prev_target'), ('n_months', 'bigint', 'other'), ('spei_annual_mean', 'double', 'spei'), ('aspect_sin', 'double', 'terrain')) AS t(\"column\", \"type\", \"group\")"


@query(f"SELECT t.*, n AS n_given FROM {_KINDS} JOIN (SELECT name, count(*) AS n FROM (UNPIVOT (SELECT CAST(COLUMNS(*) AS VARCHAR) FROM ({ORACLES['feature_table'].replace('%', '%')})) ON COLUMNS(*) INTO NAME name VALUE value) GROUP BY 1) ON name = t.\"column\"")
def feature_metadata(spark, view):
    """The column dictionary of the feature table, with how many rows have a value."""
    return features.feature_metadata(feature_table(spark, view), counted=True)


# Driver groups on the grid of the raster view: 40 x 50 source cells, the same target cells.

_SOURCE = "SELECT 'Rx1day' AS variable, 2000 AS year, r, c, value FROM v_raster UNION ALL SELECT 'Tn10p', 2000, r, c, CAST(code AS DOUBLE) * 3 FROM v_raster"


def _source(view):
    r = view("v_raster")
    one = r.select(F.lit("Rx1day").alias("variable"), F.lit(2000).alias("year"), "r", "c", "value")
    return one.unionAll(r.select(F.lit("Tn10p"), F.lit(2000), "r", "c", F.col("code").cast("double") * 3))


@query(f"SELECT variable, year, count(*) AS n, count(*) FILTER (variable = 'Rx1day' AND value BETWEEN 0 AND 1000 OR variable = 'Tn10p' AND value BETWEEN -1 AND 101) AS n_valid FROM ({_SOURCE}) GROUP BY 1, 2")
def driver_climate(spark, view):
    target = view("v_raster").select("r", "c")
    return drivers.climate(_source(view), target).groupBy("variable", "year").agg(F.count("*").alias("n"), F.count("value").alias("n_valid"))


@query("SELECT r, c, variable, round(CASE WHEN v * 0.0001::DOUBLE BETWEEN -0.2 AND 1.0 THEN v * 0.0001::DOUBLE END, 8) AS value FROM (SELECT r, c, unnest(['ndvi_annual_mean', 'ndvi_gs_mean', 'ndvi_gs_max']) AS variable, unnest([code * 100, code * 150, code * 300]) AS v FROM v_raster)")
def driver_vegetation(spark, view):
    bands = view("v_raster").select(F.lit(2001).alias("year"), "r", "c", (F.col("code") * 100).alias("band1"), (F.col("code") * 150).alias("band2"), (F.col("code") * 300).alias("band3"))
    bands = bands.repartition(tasks(view("part"), 20_000), "r", "c")  # before the bands are multiplied: a small file is read by one task
    return drivers.vegetation(bands, view("v_raster").select("r", "c")).select("r", "c", "variable", F.round("value", 8).alias("value"))


@query("SELECT 'aspect' AS variable, r, c, CAST(code * 7 AS DOUBLE) AS value FROM v_raster UNION ALL SELECT 'elevation', r, c, round(value, 6) FROM v_raster")
def driver_terrain(spark, view):
    r = view("v_raster")
    source = r.select(F.lit("elevation").alias("variable"), "r", "c", "value").unionAll(r.select(F.lit("aspect"), "r", "c", (F.col("code") * 7).cast("double")))
    return drivers.terrain(source, r.select("r", "c")).select("variable", "r", "c", F.round("value", 6).alias("value"))


@query("SELECT 'spei03_' || unnest(['annual_mean', 'min', 'n_wet']) AS variable, year, r, c, unnest([round(a, 9), round(m, 9), w]) AS value FROM (SELECT year, CAST(pixel // 50 AS INT) AS r, CAST(pixel % 50 AS INT) AS c, avg(z) AS a, min(z) AS m, CAST(count(*) FILTER (z > 1.5) AS DOUBLE) AS w FROM v_monthly GROUP BY 1, 2, 3)")
def driver_drought(spark, view):
    monthly = view("v_monthly").select(F.lit("spei03").alias("scale"), "year", "month", F.floor(F.col("pixel") / 50).cast("int").alias("r"), (F.col("pixel") % 50).cast("int").alias("c"), "z")
    out = drivers.drought(monthly, monthly.select("r", "c").distinct()).where("variable IN ('spei03_annual_mean', 'spei03_min', 'spei03_n_wet')")
    return out.select("variable", "year", "r", "c", F.round("value", 9).alias("value"))


@query("SELECT g.r AS r, g.c AS c, round(sqrt(CAST(min((g.r - w.r) * (g.r - w.r) + (g.c - w.c) * (g.c - w.c)) AS DOUBLE)), 9) AS road_distance_km FROM v_grid g CROSS JOIN v_roads w GROUP BY 1, 2")
def driver_roads(spark, view):
    return drivers.roads(view("v_grid"), view("v_roads"), _height(view), _W).select("r", "c", F.round("road_distance_km", 9).alias("road_distance_km"))


@query("SELECT CAST(k // w AS INT) AS r, CAST(k % w AS INT) AS c, x0 + (k % w + 0.5::DOUBLE) * 10000 AS x, y1 - (k // w + 0.5::DOUBLE) * 10000 AS y FROM (SELECT unnest(range(w * h)) AS k, * FROM (SELECT min(x) - 5000 AS x0, max(y) + 5000 AS y1, CAST(max(c) - min(c) + 1 AS BIGINT) AS w, CAST(max(r) - min(r) + 1 AS BIGINT) AS h FROM v_grid))")
def target_grid(spark, view):
    """The cells of the sites' extent, with the coordinates of their centres."""
    x0, y1, width, height = view("v_grid").agg(F.min("x") - 5000, F.max("y") + 5000, F.max("c") - F.min("c") + 1, F.max("r") - F.min("r") + 1).first()
    return grid.target_grid(spark, x0, y1, width, height, 10000.0)


@query("SELECT b.br AS br, b.bc AS bc, round(n.value, 10) AS value FROM (SELECT DISTINCT br, bc FROM v_blocks) b LEFT JOIN v_nodes n ON n.br = b.br AND n.bc = b.bc")
def node_raster(spark, view):
    from geoweave.operators.graph import to_raster

    return to_raster(view("v_blocks"), view("v_nodes"), "value").withColumn("value", F.round("value", 10))


@query("SELECT year, count(*) AS n, count(conf) AS n_conf FROM (SELECT pix, year, class, conf FROM v_map WHERE year <= 2005 UNION ALL SELECT pix, year, class, NULL FROM v_map WHERE year > 2005) GROUP BY 1")
def union_years(spark, view):
    m = view("v_map")
    parts = [m.where("year <= 2005"), m.where("year > 2005").drop("conf")]
    return features.union_years(parts).groupBy("year").agg(F.count("*").alias("n"), F.count("conf").alias("n_conf"))

"""Queries of driver groups on a coarser target grid, of polygons, and of grids' frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoweave.functions import dims
from geoweave.functions.expressions import Albers
from geoweave.operators import drivers, grid
from geoweave.plans.registry import query
from geoweave.plans.views import tasks

# A target cell is 1.25 x 1.75 source cells, so bilinear weights and nearest cells are no identity. The target covers the whole source.
_STEPS = {"step_r": 1.25, "step_c": 1.75}


def _target_sql(source: str = "v_raster") -> str:
    return f"SELECT CAST(k // w AS INT) AS r, CAST(k % w AS INT) AS c FROM (SELECT unnest(range(h * w)) AS k, w FROM (SELECT CAST(ceil((max(r) + 1) / 1.25) AS BIGINT) AS h, CAST(ceil((max(c) + 1) / 1.75) AS BIGINT) AS w FROM {source}))"


_TARGET = _target_sql()


def _target(spark, source):
    return grid.covering(spark, source, **_STEPS)


def _bands(view, *groups: str):
    return view("v_bands").where(F.col("grp").isin(*groups)).select("variable", "year", "r", "c", "value")


def _bilinear(source: str, keys: str, target: str = _TARGET) -> str:
    """The bilinear mean of ``source`` (keys, r, c, value) on the target, as SQL."""
    return f"""SELECT {keys}, k.r AS r, k.c AS c, sum(w * value) / sum(w) AS value FROM (SELECT r, c, CAST(floor(y) AS INT) + i.d AS sr, CAST(floor(x) AS INT) + j.d AS sc,
CASE i.d WHEN 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END * CASE j.d WHEN 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END AS w
FROM (SELECT r, c, (r + 0.5::DOUBLE) * 1.25 - 0.5 AS y, (c + 0.5::DOUBLE) * 1.75 - 0.5 AS x FROM ({target})) CROSS JOIN (VALUES (0), (1)) i(d) CROSS JOIN (VALUES (0), (1)) j(d)) k
JOIN ({source}) s ON s.r = sr AND s.c = sc WHERE w > 0 AND value IS NOT NULL GROUP BY {keys}, k.r, k.c"""


def _group(name: str, condition: str = "TRUE", value: str = "value") -> str:
    return _bilinear(f"SELECT variable, year, r, c, {value} AS value FROM v_bands WHERE grp = '{name}' AND {condition}", "variable, year")


_RANGES = " ".join(f"WHEN variable = '{v}' THEN CASE WHEN value BETWEEN {a} AND {b} THEN value END" for v, (a, b) in dims.PLAUSIBLE.items() if v in ("CDD", "Rx1day", "TNn"))


@query(f"SELECT variable, year, r, c, round(CASE {_RANGES} END, 10) AS value FROM ({_group('climate')})")
def driver_climate_values(spark, view):
    return drivers.climate(_bands(view, "climate"), _target(spark, view("v_raster")), **_STEPS).withColumn("value", F.round("value", 10))


@query(f"SELECT variable, year, r, c, round(value, 10) AS value FROM ({_group('grazing')})")
def driver_grazing(spark, view):
    return drivers.plain(_bands(view, "grazing"), _target(spark, view("v_raster")), **_STEPS).withColumn("value", F.round("value", 10))


@query(f"SELECT variable, year, r, c, round(CASE WHEN value BETWEEN 1 AND 366 THEN value END, 10) AS value FROM ({_group('phenology')})")
def driver_phenology(spark, view):
    return drivers.phenology(_bands(view, "phenology"), _target(spark, view("v_raster")), **_STEPS).withColumn("value", F.round("value", 10))


@query(f"SELECT variable, year, r, c, round(value, 10) AS value FROM ({_group('population', 'value <> -99999')})")
def driver_population(spark, view):
    return drivers.population(_bands(view, "population"), _target(spark, view("v_raster")), **_STEPS).withColumn("value", F.round("value", 10))


@query(f"SELECT variable, year, r, c, round(value, 10) AS value FROM ({_group('livestock')})")
def driver_livestock(spark, view):
    return drivers.plain(_bands(view, "livestock"), _target(spark, view("v_raster")), **_STEPS).withColumn("value", F.round("value", 10))


_NEAREST = f"SELECT variable, year, t.r AS r, t.c AS c, CASE WHEN value <> 255 THEN value END AS value FROM ({_TARGET}) t JOIN v_bands s ON s.r = CAST(floor((t.r + 0.5) * 1.25) AS INT) AND s.c = CAST(floor((t.c + 0.5) * 1.75) AS INT) WHERE grp = 'cropping'"


@query(_NEAREST)
def driver_cropping(spark, view):
    return drivers.cropping(_bands(view, "cropping"), _target(spark, view("v_raster")), **_STEPS)


_NDVI = "SELECT unnest(['ndvi_annual_mean', 'ndvi_gs_mean', 'ndvi_gs_max']) AS variable, 2001 AS year, r, c, unnest([code * 100, code * 150, code * 300]) * 0.0001::DOUBLE AS value FROM v_raster"


@query(f"SELECT variable, year, r, c, round(CASE WHEN value BETWEEN -0.2 AND 1.0 THEN value END, 10) AS value FROM ({_bilinear(_NDVI, 'variable, year')})")
def driver_vegetation_values(spark, view):
    bands = view("v_raster").select(F.lit(2001).alias("year"), "r", "c", (F.col("code") * 100).alias("band1"), (F.col("code") * 150).alias("band2"), (F.col("code") * 300).alias("band3"))
    return drivers.vegetation(bands, _target(spark, view("v_raster")), **_STEPS).withColumn("value", F.round("value", 10))


@query(f"""SELECT variable, r, c, round(CASE WHEN value BETWEEN -500 AND 9000 THEN value END, 10) AS value FROM ({_bilinear("SELECT 'elevation' AS variable, r, c, code * 200.0 - 700 AS value FROM v_raster", 'variable')})
UNION ALL SELECT 'aspect', t.r, t.c, CASE WHEN code * 11 BETWEEN 0 AND 360 THEN CAST(code * 11 AS DOUBLE) END FROM ({_TARGET}) t JOIN v_raster s ON s.r = CAST(floor((t.r + 0.5) * 1.25) AS INT) AND s.c = CAST(floor((t.c + 0.5) * 1.75) AS INT)""")
def driver_terrain_values(spark, view):
    r = view("v_raster")
    source = r.select(F.lit("elevation").alias("variable"), "r", "c", (F.col("code") * F.lit(200.0) - 700).alias("value")).unionAll(r.select(F.lit("aspect"), "r", "c", (F.col("code") * 11).cast("double")))
    return drivers.terrain(source, _target(spark, view("v_raster")), **_STEPS).select("variable", "r", "c", F.round("value", 10).alias("value"))


_STATS = "'annual_mean', 'gs_mean', 'min', 'max', 'n_severe_drought', 'n_moderate_drought', 'n_wet'"
_MONTHLY = f"""SELECT scale || '_' || unnest([{_STATS}]) AS variable, year, r, c, unnest([a, coalesce(g, a), lo, hi, CAST(severe AS DOUBLE), CAST(moderate AS DOUBLE), CAST(wet AS DOUBLE)]) AS value
FROM (SELECT scale, year, CAST(pixel // 50 AS INT) AS r, CAST(pixel % 50 AS INT) AS c, avg(v) AS a, avg(v) FILTER (month BETWEEN 4 AND 9) AS g, min(v) AS lo, max(v) AS hi, count(*) FILTER (v < -1.5) AS severe, count(*) FILTER (v >= -1.5 AND v < -1.0) AS moderate, count(*) FILTER (v > 1.5) AS wet
FROM (SELECT pixel, year, month, unnest(['spei03', 'spei06', 'spei12']) AS scale, unnest([z, z / 2.0, z - 0.25]) AS v FROM v_monthly) GROUP BY 1, 2, 3, 4)"""


@query(f"SELECT variable, year, r, c, round(value + 1e-9, 6) AS value FROM ({_bilinear(_MONTHLY, 'variable, year', _target_sql('(SELECT pixel // 50 AS r, pixel % 50 AS c FROM v_monthly)'))})")
def driver_drought_values(spark, view):
    """All seven statistics of three time scales."""
    z = F.col("z")
    scales = F.inline(F.array(F.struct(F.lit("spei03").alias("scale"), z.alias("z")), F.struct(F.lit("spei06").alias("scale"), (z / F.lit(2.0)).alias("z")), F.struct(F.lit("spei12").alias("scale"), (z - F.lit(0.25)).alias("z"))))
    cells = view("v_monthly").select("year", "month", F.floor(F.col("pixel") / 50).cast("int").alias("r"), (F.col("pixel") % 50).cast("int").alias("c"), "z")
    # Dealt by number before the scales multiply the months: the statistics of a cell are made in one task and meet the target there.
    monthly = cells.repartition(tasks(view("orders"), 50_000), "r", "c").select("year", "month", "r", "c", scales)
    return drivers.drought(monthly, _target(spark, cells), **_STEPS).select("variable", "year", "r", "c", F.round(F.col("value") + 1e-9, 6).alias("value"))


@query(f"""SELECT grp AS "group", variable, year, count(*) AS n, count(value) AS n_valid FROM (
SELECT 'grazing' AS grp, * FROM ({_group('grazing', 'year = 2000')}) UNION ALL SELECT 'phenology', variable, year, r, c, CASE WHEN value BETWEEN 1 AND 366 THEN value END FROM ({_group('phenology', 'year = 2000')})
UNION ALL SELECT 'population', * FROM ({_group('population', 'value <> -99999 AND year = 2000')})) GROUP BY 1, 2, 3""")
def driver_dispatch(spark, view):
    """Groups by name, one year: a group without that year has no rows."""
    sources = {g: _bands(view, g) for g in ("grazing", "phenology", "population", "livestock")}
    out = drivers.aligned(["grazing", "phenology", "population"], sources, _target(spark, view("v_raster")), years=[2000], **_STEPS)
    return out.groupBy("group", "variable", "year").agg(F.count("*").alias("n"), F.count("value").alias("n_valid"))


# -- Polygons.

_INSIDE = """SELECT g.r AS r, g.c AS c, e.poly AS poly FROM v_grid g JOIN v_edge e ON (e.y1 <= g.r + 0.5) <> (e.y2 <= g.r + 0.5) AND e.x1 + (g.r + 0.5 - e.y1) / (e.y2 - e.y1) * (e.x2 - e.x1) > g.c + 0.5
GROUP BY 1, 2, 3 HAVING count(*) % 2 = 1"""
_TOUCHED = f"""{_INSIDE} UNION SELECT g.r, g.c, poly FROM v_grid g JOIN (SELECT poly, r, CAST(floor(least(a, b)) AS INT) AS c0, CAST(floor(greatest(a, b)) AS INT) AS c1
FROM (SELECT poly, r, x1 + (greatest(least(y1, y2), least(greatest(y1, y2), r)) - y1) / (y2 - y1) * (x2 - x1) AS a, x1 + (greatest(least(y1, y2), least(greatest(y1, y2), r + 1)) - y1) / (y2 - y1) * (x2 - x1) AS b
FROM (SELECT *, unnest(range(CAST(floor(least(y1, y2)) AS INT), CAST(floor(greatest(y1, y2)) AS INT) + 1)) AS r FROM v_edge))) q ON q.r = g.r AND g.c BETWEEN c0 AND c1"""


@query(f"SELECT r, c, code FROM (SELECT b.r, b.c, t.code, row_number() OVER (PARTITION BY b.r, b.c ORDER BY t.seq DESC) AS rn FROM ({_INSIDE}) b JOIN v_triangle t ON t.poly = b.poly) WHERE rn = 1")
def driver_desertification(spark, view):
    return drivers.desertification(view("v_grid"), view("v_edge"), view("v_triangle").select("poly", "code", "seq"))


@query(f"SELECT year, b.r AS r, b.c AS c, count(DISTINCT day) AS n FROM ({_TOUCHED}) b JOIN v_triangle t ON t.poly = b.poly GROUP BY 1, 2, 3")
def driver_sandstorm(spark, view):
    """Every cell that a storm's polygon touches, by the day."""
    return drivers.storms(view("v_grid"), view("v_edge"), view("v_triangle").select("poly", "year", "day")).select("year", "r", "c", "n")


@query(_TOUCHED)
def polygon_touched(spark, view):
    return grid.burn_touched(view("v_grid"), view("v_edge")).select("r", "c", "poly")


_PARTS = "SELECT poly, x1, y1, x2, y2 FROM v_edge UNION ALL SELECT poly, x1 * 0.4 + hx * 0.6, y1 * 0.4 + hy * 0.6, x2 * 0.4 + hx * 0.6, y2 * 0.4 + hy * 0.6 FROM v_edge JOIN (SELECT poly AS hp, x + 11.2 AS hx, y + 9.6 AS hy FROM v_triangle) ON hp = poly UNION ALL SELECT poly, x1 * 0.25 + 30.5, y1 * 0.25 + 3.1, x2 * 0.25 + 30.5, y2 * 0.25 + 3.1 FROM v_edge"


@query(_INSIDE.replace("v_edge", f"({_PARTS})"))
def polygon_parts(spark, view):
    """Polygons with a hole and a second part, by spans of scan lines."""
    e, t = view("v_edge"), view("v_triangle").select("poly", (F.col("x") + 11.2).alias("hx"), (F.col("y") + 9.6).alias("hy"))
    near = lambda c, h: (F.col(c) * 0.4 + F.col(h) * 0.6).alias(c)
    hole = e.join(t, "poly").select("poly", near("x1", "hx"), near("y1", "hy"), near("x2", "hx"), near("y2", "hy"))
    part = e.select("poly", *((F.col(c) * 0.25 + shift).alias(c) for c, shift in (("x1", 30.5), ("y1", 3.1), ("x2", 30.5), ("y2", 3.1))))
    return grid.burn_polygons(view("v_grid"), e.union(hole).union(part)).select("r", "c", "poly")


# -- Frames of grids.

_EXTENT = (20.0, 10.0, 80.0, 60.0)


@query("SELECT n_nationkey AS id, NOT (c1 <= 20 OR c0 >= 80 OR r1 <= 10 OR r0 >= 60) AS overlaps FROM (SELECT n_nationkey, n_nationkey % 5 * 25 AS c0, n_nationkey % 5 * 25 + 10 AS c1, n_nationkey // 5 * 24 AS r0, n_nationkey // 5 * 24 + 10 AS r1 FROM nation)")
def raster_overlap(spark, view):
    n = view("v_rect").select(F.col("seq").alias("id"), "c0", "r0")
    return n.select("id", grid.overlaps(F.col("c0"), F.col("r0"), F.col("c0") + 10, F.col("r0") + 10, _EXTENT).alias("overlaps"))


@query("""SELECT CAST(k // w AS INT) AS r, CAST(k % w AS INT) AS c, x0 + (k % w + 0.5::DOUBLE) * 25000 AS x, y1 - (k // w + 0.5::DOUBLE) * 25000 AS y
FROM (SELECT unnest(range(w * h)) AS k, * FROM (SELECT x0, y1, CAST((ceil(xb / 25000) * 25000 - x0) / 25000 AS BIGINT) AS w, CAST((y1 - floor(ya / 25000) * 25000) / 25000 AS BIGINT) AS h
FROM (SELECT floor(min(x) / 25000) * 25000 AS x0, max(x) AS xb, min(y) AS ya, ceil(max(y) / 25000) * 25000 AS y1 FROM v_grid)))""")
def target_grid_snapped(spark, view):
    """The least grid of 25 km cells on whole multiples that holds all sites."""
    x0, y0, x1, y1 = view("v_grid").agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    left, top, width, height = grid.snapped_extent(x0, y0, x1, y1, 25000.0)
    return grid.target_grid(spark, left, top, width, height, 25000.0)


@query("SELECT (SELECT max(r) FROM v_raster) - r AS row, c AS col, 80 + c * 0.25::DOUBLE - 0.125 AS \"left\", 30 + r * 0.25::DOUBLE + 0.125 AS top, value FROM v_raster")
def lonlat_north_up(spark, view):
    """A grid whose rows count from the south, written from the north-west corner on, with the cells' edges."""
    points = view("v_raster").select((F.lit(80.0) + F.col("c") * F.lit(0.25)).alias("lon"), (F.lit(30.0) + F.col("r") * F.lit(0.25)).alias("lat"), "value")
    return grid.north_up(points)


def _forward_sql(lon: str, lat: str) -> tuple[str, str]:
    a = Albers()
    s = f"sin(radians({lat}))"
    q = f"({s} / (1.0::DOUBLE - {s} * {s} * {a.e2!r}) - ln((1.0::DOUBLE - {s} * {a.e!r}) / (1.0::DOUBLE + {s} * {a.e!r})) / {2 * a.e!r}) * {1 - a.e2!r}"
    rho, theta = f"(sqrt({a.c!r} - {q} * {a.n!r}) * {a.a / a.n!r})", f"(radians({lon} - {a.lon0!r}) * {a.n!r})"
    return f"{rho} * sin({theta})", f"{a.rho0!r} - {rho} * cos({theta})"


(_X1, _Y1), (_X2, _Y2) = _forward_sql("x1", "y1"), _forward_sql("x2", "y2")
_ROADS = "SELECT n_nationkey AS id, 95 + n_nationkey::DOUBLE AS x1, 28 + n_regionkey * 4::DOUBLE AS y1, 97.5 + n_nationkey::DOUBLE AS x2, 29.25 + n_regionkey * 4::DOUBLE AS y2 FROM nation"


@query(f"SELECT id, round({_X1}, 3) AS x1, round({_Y1}, 3) AS y1, round({_X2}, 3) AS x2, round({_Y2}, 3) AS y2 FROM ({_ROADS}) WHERE x2 >= 100 AND x1 <= 112 AND y2 >= 30 AND y1 <= 41")
def segments_projected(spark, view):
    """Lines in degrees: those whose box meets the extent, in metres of the projection."""
    n, g = F.col("n_nationkey").cast("double"), F.col("n_regionkey") * F.lit(4.0)
    lines = view("nation").select(F.col("n_nationkey").alias("id"), (n + 95).alias("x1"), (g + 28).alias("y1"), (n + 97.5).alias("x2"), (g + 29.25).alias("y2"))
    return grid.segments_within(lines, (100.0, 30.0, 112.0, 41.0), Albers().forward).select("id", *(F.round(c, 3).alias(c) for c in ("x1", "y1", "x2", "y2")))


_LINES = "SELECT n_nationkey AS id, 99.5 + n_nationkey % 11 AS x1, 44.2 + n_regionkey * 1.7 AS y1, 99.5 + n_nationkey % 11 + 2.4 AS x2, 45.6 + n_regionkey * 1.7 - n_nationkey % 3 AS y2 FROM nation"
_ROAD_CELLS = f"""l AS (SELECT id, (({_X1}) + 625000.0) / 10000 AS x1, (5905000.0 - ({_Y1})) / 10000 AS y1, (({_X2}) + 625000.0) / 10000 AS x2, (5905000.0 - ({_Y2})) / 10000 AS y2 FROM ({_LINES})),
cut AS (SELECT r, CASE WHEN y1 = y2 THEN x1 ELSE x1 + (greatest(least(y1, y2), least(greatest(y1, y2), r)) - y1) / (y2 - y1) * (x2 - x1) END AS a, CASE WHEN y1 = y2 THEN x2 ELSE x1 + (greatest(least(y1, y2), least(greatest(y1, y2), r + 1)) - y1) / (y2 - y1) * (x2 - x1) END AS b
        FROM (SELECT *, unnest(range(CAST(floor(least(y1, y2)) AS INT), CAST(floor(greatest(y1, y2)) AS INT) + 1)) AS r FROM l)),
w AS (SELECT DISTINCT r, unnest(range(CAST(floor(least(a, b)) AS INT), CAST(floor(greatest(a, b)) AS INT) + 1)) AS c FROM cut),
k AS (SELECT w.r, w.c FROM w, (SELECT max(r) AS h, min(c) AS c0, max(c) AS c1 FROM v_grid) WHERE w.r BETWEEN 0 AND h AND w.c BETWEEN c0 AND c1)"""


@query(f"WITH {_ROAD_CELLS} SELECT g.r AS r, g.c AS c, round(sqrt(CAST(min((g.r - k.r) * (g.r - k.r) + (g.c - k.c) * (g.c - k.c)) AS DOUBLE)), 9) AS road_distance_km FROM v_grid g CROSS JOIN k GROUP BY 1, 2")
def driver_road_lines(spark, view):
    """Road segments in degrees, projected, walked through the cells, and the distance of every cell to them."""
    k = F.col("n_nationkey")
    lines = view("nation").select(k.alias("id"), (F.lit(99.5) + k % 11).alias("x1"), (F.lit(44.2) + F.col("n_regionkey") * 1.7).alias("y1"), (F.lit(99.5) + k % 11 + 2.4).alias("x2"), (F.lit(45.6) + F.col("n_regionkey") * 1.7 - k % 3).alias("y2"))
    projected = grid.segments_within(lines, (-180.0, -90.0, 180.0, 90.0), Albers().forward)
    cells = view("v_grid")
    out = drivers.roads_from_lines(cells, projected, -625000.0, 5905000.0, 10000.0, 0, 125)
    return out.select("r", "c", F.round("road_distance_km", 9).alias("road_distance_km"))

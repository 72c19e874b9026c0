"""The feature table by group and as a whole, on the site grid: one query for each group of columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoweave.functions import dims
from geoweave.functions.expressions import Albers, aspect_cos, aspect_sin
from geoweave.operators import drivers, features, grid
from geoweave.plans.registry import query

_WIDTH = 20
_CLASSES = range(1, 15)
_SLOPES, _BASELINE = ((5, 3), (10, 5)), (1990, 2019, 10)
_CLIMATE = {v: f"clim_{v}" for v in ("CDD", "CWD", "GSL", "R10", "R20", "Rx1day", "Rx5day", "Tn10p", "Tn90p", "TNn", "TNx", "Tx10p", "Tx90p", "TXn", "TXx")}
_CLIMATE_STATS = {"state": "", "slope5y": "_slope5y", "slope10y": "_slope10y", "anomaly": "_anomaly"}
_PHENOLOGY = {"sos": "phen_sos", "eos": "phen_eos", "los": "phen_los"}
_GRAZING = {v: v for v in ("graz_total", "graz_cattle", "graz_sheep", "graz_goat", "graz_bigl")}
_DROUGHT = {v: v for v in (f"{s}_{x}" for s in ("spei03", "spei06", "spei12") for x in ("annual_mean", "gs_mean", "annual_min", "annual_max", "n_severe_drought", "n_severe_wet"))}
_NDVI = {v: v for v in ("ndvi_annual_mean", "ndvi_gs_mean", "ndvi_gs_max")}


def _long_sql(variables, at_state: bool = False) -> str:
    """All statistics of the named variables at every anchor, as SQL."""
    base = "n.source" if at_state else "n.anchor"
    inside = lambda k: f"CASE WHEN d.year BETWEEN {base} - {k - 1} AND {base} THEN value END"
    slope = lambda k, least: f"CASE WHEN count({inside(k)}) >= 3 AND l{k} >= {least} THEN regr_slope({inside(k)}, CAST(d.year AS DOUBLE)) END AS slope{k}y"
    names = ", ".join(f"'{v}'" for v in variables)
    return f"""SELECT d.pix AS pix, n.anchor AS year, d.variable AS variable, max(CASE WHEN d.year = n.source THEN value END) AS state, {slope(5, 3)}, {slope(10, 5)},
CASE WHEN count(CASE WHEN d.year BETWEEN 1990 AND 2019 THEN value END) >= 10 THEN max(CASE WHEN d.year = n.source THEN value END) - avg(CASE WHEN d.year BETWEEN 1990 AND 2019 THEN value END) END AS anomaly
FROM (SELECT * FROM v_driver WHERE variable IN ({names})) d JOIN (
  SELECT n.variable, n.anchor, n.source, count(*) FILTER (x.year BETWEEN {base} - 4 AND {base}) AS l5, count(*) FILTER (x.year BETWEEN {base} - 9 AND {base}) AS l10
  FROM (SELECT variable, anchor, source FROM (SELECT v.variable, a.year AS anchor, v.year AS source, row_number() OVER (PARTITION BY v.variable, a.year ORDER BY abs(v.year - a.year), v.year) AS rn
        FROM (SELECT DISTINCT variable, year FROM v_driver) v CROSS JOIN v_anchor a) WHERE rn = 1) n
  JOIN (SELECT DISTINCT variable, year FROM v_driver) x ON x.variable = n.variable GROUP BY 1, 2, 3) n ON n.variable = d.variable GROUP BY d.pix, n.anchor, d.variable, n.source, l5, l10"""


def _wide_sql(names: dict, stats: dict, at_state: bool = False) -> str:
    columns = ", ".join(f"round(max(CASE WHEN variable = '{v}' THEN {c} END), 9) + 0.0 AS {n}{s}" for v, n in names.items() for c, s in stats.items())
    return f"SELECT pix, year, {columns} FROM ({_long_sql(names, at_state)}) GROUP BY 1, 2"


def _rounded(df, digits: int = 9):
    return df.select(*((F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _group(view, names: dict, stats: dict, slopes=(), baseline=None, at_state: bool = False):
    long = view("v_driver").where(F.col("variable").isin(*names))
    return _rounded(features.wide(features.long_features(long, dims.ANCHORS, slopes=slopes, baseline=baseline, at_state=at_state), names, stats))


@query("SELECT pix, year, class AS lulc_class, conf_joint, conf_l1, conf_l2, agreement_count FROM v_target")
def features_target(spark, view):
    return view("v_target").select("pix", "year", F.col("class").alias("lulc_class"), "conf_joint", "conf_l1", "conf_l2", "agreement_count")


_PREVIOUS = "SELECT a.pix AS pix, a.year AS year, b.class AS lulc_class_prev, CASE WHEN a.class > 0 AND b.class > 0 THEN CAST(a.class <> b.class AS INT) END AS lulc_change_flag FROM v_target a JOIN v_target b ON b.pix = a.pix AND b.year = a.year - 5"


@query(_PREVIOUS)
def features_previous(spark, view):
    return features.previous_target(view("v_target"))


@query(_wide_sql(_CLIMATE, _CLIMATE_STATS))
def features_climate(spark, view):
    return _group(view, _CLIMATE, _CLIMATE_STATS, _SLOPES, _BASELINE)


@query(_wide_sql(_DROUGHT, {"state": ""}))
def features_drought(spark, view):
    return _group(view, _DROUGHT, {"state": ""})


_NDVI_SQL = f"SELECT pix, year, ndvi_annual_mean, ndvi_gs_mean, ndvi_gs_max, ndvi_gs_mean_slope5y FROM ({_wide_sql(_NDVI, {'state': '', 'slope5y': '_slope5y'}, True)})"


@query(_NDVI_SQL)
def features_vegetation(spark, view):
    """Slopes end with the year of the layer that is used."""
    return _group(view, _NDVI, {"state": "", "slope5y": "_slope5y"}, _SLOPES[:1], at_state=True).select("pix", "year", "ndvi_annual_mean", "ndvi_gs_mean", "ndvi_gs_max", "ndvi_gs_mean_slope5y")


@query(_wide_sql(_PHENOLOGY, {"state": "", "slope5y": "_slope5y"}, True))
def features_phenology(spark, view):
    return _group(view, _PHENOLOGY, {"state": "", "slope5y": "_slope5y"}, _SLOPES[:1], at_state=True)


@query(_wide_sql(_GRAZING, {"state": ""}))
def features_grazing(spark, view):
    return _group(view, _GRAZING, {"state": ""})


@query(_wide_sql({"cropping": "cropping_intensity"}, {"state": ""}))
def features_cropping(spark, view):
    return _group(view, {"cropping": "cropping_intensity"}, {"state": ""})


@query(_wide_sql({"popdens": "popdens"}, {"state": ""}))
def features_population(spark, view):
    return _group(view, {"popdens": "popdens"}, {"state": ""})


@query(_wide_sql({"glw": "glw_density"}, {"state": ""}))
def features_livestock(spark, view):
    """Layers of 2010 and 2020 only: 2015 takes the earlier."""
    return _group(view, {"glw": "glw_density"}, {"state": ""})


_TERRAIN = """SELECT pix, CASE WHEN e BETWEEN -500 AND 9000 THEN e END AS elevation, CASE WHEN s BETWEEN 0 AND 90 THEN s END AS slope, CASE WHEN a BETWEEN 0 AND 360 THEN round(sin(radians(a)), 6) + 0.0 END AS aspect_sin, CASE WHEN a BETWEEN 0 AND 360 THEN round(cos(radians(a)), 6) + 0.0 END AS aspect_cos
FROM (SELECT pix, CAST(pix * 137 % 9800 - 600 AS DOUBLE) AS e, CAST(pix * 3 % 97 AS DOUBLE) AS s, CAST(pix * 11 % 400 AS DOUBLE) AS a FROM v_site)"""


@query(_TERRAIN)
def features_terrain(spark, view):
    pix = F.col("pix")
    values = {"elevation": pix * 137 % 9800 - 600, "slope": pix * 3 % 97, "aspect": pix * 11 % 400}
    long = view("v_site").select("pix", F.inline(F.array(*(F.struct(F.lit(n).alias("variable"), v.cast("double").alias("value")) for n, v in values.items()))))
    held = features.wide(features.clamp_table(long, dims.PLAUSIBLE), {n: n for n in values}, {"value": ""}, keys=("pix",))
    return held.select("pix", "elevation", "slope", (F.round(aspect_sin(F.col("aspect")), 6) + 0.0).alias("aspect_sin"), (F.round(aspect_cos(F.col("aspect")), 6) + 0.0).alias("aspect_cos"))


_ROAD = "SELECT g.pix AS pix, round(sqrt(CAST(min((g.r - w.r) * (g.r - w.r) + (g.c - w.c) * (g.c - w.c)) AS DOUBLE)), 6) AS road_distance_km FROM v_site g CROSS JOIN (SELECT r, c FROM v_site WHERE pix % 9 = 0) w GROUP BY 1"


def _height(view) -> int:
    return int(view("v_site").agg(F.max("r")).first()[0]) + 1


@query(_ROAD)
def features_roads(spark, view):
    site = view("v_site")
    d = drivers.roads(site, site.where("pix % 9 = 0"), _height(view), _WIDTH)
    return site.select("pix", "r", "c").join(d, ["r", "c"]).select("pix", F.round("road_distance_km", 6).alias("road_distance_km"))


_REFLECT = "CASE WHEN {0} < 0 THEN -({0}) - 1 WHEN {0} >= {1} THEN 2 * {1} - 1 - ({0}) ELSE {0} END"
_AROUND = f"""SELECT g.pix AS pix, g.year AS year, {", ".join(f"count(*) FILTER (m.class = {k}) / 9.0::DOUBLE AS nbr3_class{k}_frac" for k in _CLASSES)}
FROM (SELECT t.pix, t.year, {_REFLECT.format("(t.r + i.d)", "h.h")} AS nr, {_REFLECT.format("(t.c + j.d)", _WIDTH)} AS nc FROM v_target t CROSS JOIN (SELECT max(r) + 1 AS h FROM v_site) h CROSS JOIN (VALUES (-1), (0), (1)) i(d) CROSS JOIN (VALUES (-1), (0), (1)) j(d)) g
LEFT JOIN v_target m ON m.r = g.nr AND m.c = g.nc AND m.year = g.year GROUP BY 1, 2"""


@query(f"SELECT pix, year, {', '.join(f'round(nbr3_class{k}_frac, 9) AS nbr3_class{k}_frac' for k in _CLASSES)} FROM ({_AROUND})")
def features_neighbours(spark, view):
    t = view("v_target")
    found = grid.class_fractions(t.where("class > 0"), _height(view), _WIDTH, _CLASSES, keys=("year",))
    columns = features.neighbour_columns(found, _CLASSES, keys=("year", "r", "c"))
    held = t.select("pix", "year", "r", "c").join(columns, ["year", "r", "c"], "left").drop("r", "c").na.fill(0.0)
    return _rounded(held.select("pix", "year", *(f"nbr3_class{k}_frac" for k in _CLASSES)))


def _coordinates_sql() -> str:
    a = Albers()
    p2, p4, p6 = a.series
    return f"""SELECT pix, r AS row, c AS col, x, y, round(degrees(atan2(x, dy) / {a.n!r}) + {a.lon0!r}, 6) AS lon, round(degrees(beta + sin(beta * 2) * {p2!r} + sin(beta * 4) * {p4!r} + sin(beta * 6) * {p6!r}), 6) AS lat
FROM (SELECT pix, r, c, x, y, dy, asin(({a.c!r} - (x * x + dy * dy) * {a.n**2 / a.a**2!r}) / {a.n!r} / {a.qp!r}) AS beta FROM (SELECT *, {a.rho0!r} - y AS dy FROM v_site))"""


@query(_coordinates_sql())
def features_coordinates(spark, view):
    lon, lat = Albers().inverse(F.col("x"), F.col("y"))
    return view("v_site").select("pix", F.col("r").alias("row"), F.col("c").alias("col"), "x", "y", F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


_STATIC = (features_coordinates, features_terrain, features_roads)
_YEAR_SQL = (_PREVIOUS, _wide_sql(_CLIMATE, _CLIMATE_STATS), _wide_sql(_DROUGHT, {"state": ""}), _NDVI_SQL, _wide_sql(_PHENOLOGY, {"state": "", "slope5y": "_slope5y"}, True), _wide_sql(_GRAZING, {"state": ""}),
             _wide_sql({"cropping": "cropping_intensity"}, {"state": ""}), _wide_sql({"popdens": "popdens"}, {"state": ""}), _wide_sql({"glw": "glw_density"}, {"state": ""}),
             f"SELECT pix, year, {', '.join(f'round(nbr3_class{k}_frac, 9) AS nbr3_class{k}_frac' for k in _CLASSES)} FROM ({_AROUND})")
_STATIC_SQL = (_coordinates_sql(), _TERRAIN, _ROAD)


def _table_sql() -> str:
    parts = " ".join(f"LEFT JOIN ({q}) y{i} ON y{i}.pix = t.pix AND y{i}.year = t.year" for i, q in enumerate(_YEAR_SQL))
    parts += " " + " ".join(f"LEFT JOIN ({q}) s{i} ON s{i}.pix = t.pix" for i, q in enumerate(_STATIC_SQL))
    columns = ", ".join([f"y{i}.* EXCLUDE (pix, year)" for i in range(len(_YEAR_SQL))] + [f"s{i}.* EXCLUDE (pix)" for i in range(len(_STATIC_SQL))])
    return f"SELECT t.pix, t.year, t.class AS lulc_class, t.conf_joint, t.conf_l1, t.conf_l2, t.agreement_count, {columns} FROM v_target t {parts}"


_STATE = {"state": ""}
_BY_ANCHOR = [(_CLIMATE, _CLIMATE_STATS), (_DROUGHT, _STATE), (_GRAZING, _STATE), ({"cropping": "cropping_intensity"}, _STATE), ({"popdens": "popdens"}, _STATE), ({"glw": "glw_density"}, _STATE)]
_BY_STATE = [(_NDVI, _STATE), ({"ndvi_gs_mean": "ndvi_gs_mean"}, {"slope5y": "_slope5y"}), (_PHENOLOGY, {"state": "", "slope5y": "_slope5y"})]


def _table(spark, view):
    """All yearly groups come from two aggregations of the layers, one for either way to end a slope, and one shuffle brings all columns together."""
    parts = [features_previous(spark, view), features_neighbours(spark, view), *(f(spark, view) for f in _STATIC)]
    for groups, options in ((_BY_ANCHOR, {"slopes": _SLOPES, "baseline": _BASELINE}), (_BY_STATE, {"slopes": _SLOPES[:1], "at_state": True})):
        layers = view("v_driver").where(F.col("variable").isin(*{v for names, _ in groups for v in names}))
        parts.append(_rounded(features.wide_groups(features.long_features(layers, dims.ANCHORS, **options), groups)))
    return features.assembled(features_target(spark, view), parts)


@query(_table_sql())
def feature_table_wide(spark, view):
    """Every group of columns side by side: a cell and anchor year a row."""
    return _table(spark, view)


_UNPIVOT = "(UNPIVOT (SELECT CAST(COLUMNS(*) AS VARCHAR) FROM ({0})) ON COLUMNS(*) INTO NAME name VALUE value)"


@query(f"""SELECT CASE WHEN name IN ('row', 'col', 'x', 'y', 'lon', 'lat', 'year') THEN 'geometry' WHEN name IN ('lulc_class', 'conf_joint', 'conf_l1', 'conf_l2', 'agreement_count') THEN 'target' WHEN name LIKE 'lulc_%' THEN 'prev_target'
WHEN name LIKE 'clim_%' THEN 'climate' WHEN name LIKE 'spei%' THEN 'spei' WHEN name LIKE 'ndvi_%' THEN 'ndvi' WHEN name LIKE 'phen_%' THEN 'phenology' WHEN name LIKE 'graz_%' THEN 'grazing' WHEN name LIKE 'cropping_%' THEN 'cropping'
WHEN name = 'popdens' THEN 'population' WHEN name = 'glw_density' THEN 'livestock' WHEN name LIKE 'nbr3_%' THEN 'spatial_ctx' WHEN name IN ('elevation', 'slope', 'aspect_sin', 'aspect_cos') THEN 'terrain' WHEN name = 'road_distance_km' THEN 'roads' ELSE 'other' END AS "group",
CAST(count(DISTINCT name) AS INT) AS n, count(*) AS n_given FROM {_UNPIVOT.format(_table_sql())} GROUP BY 1""")
def feature_group_sizes(spark, view):
    """Columns of each group in the wide table, and how many values they have."""
    return features.feature_metadata(_table(spark, view), counted=True).groupBy("group").agg(F.count("*").cast("int").alias("n"), F.sum("n_given").alias("n_given"))


@query(f"SELECT 'lulc_class' AS target, name AS feature, count(*) AS n_given FROM {_UNPIVOT.format(_wide_sql(_CLIMATE, {'state': ''}))} WHERE name LIKE 'clim_%' GROUP BY 2")
def feature_split(spark, view):
    """The features and the target of a table, without columns that are named or share a prefix, and how many rows have a value of each."""
    climate = features_climate(spark, view).select("pix", "year", *_CLIMATE.values())
    held = features_target(spark, view).join(climate, ["pix", "year"])
    names, target = features.split_features(held, "lulc_class", ("pix", "year"), ("conf_", "agreement"))
    return features.given(held.select(*names)).select(F.lit(target).alias("target"), F.col("column").alias("feature"), "n_given")

"""Queries of harmonisation and fusion."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from geoweave.functions import dims
from geoweave.operators import fusion, harmonize
from geoweave.plans.registry import query

_P = list(dims.PRODUCTS)
_L1 = "CASE " + " ".join(f"WHEN {{0}} = {u} THEN {l}" for u, l in dims.UNIFIED_TO_L1.items() if l) + " ELSE 0 END"


def _cells(view):
    return view("v_aoi").crossJoin(F.broadcast(view("v_anchor").select("year")))


@query("SELECT v.product_id AS product_id, coalesce(k.unified, 0) AS unified, count(*) AS n FROM v_votes v LEFT JOIN v_codes k ON k.product_id = v.product_id AND k.native = v.native GROUP BY 1, 2")
def harmonize_remap(spark, view):
    return harmonize.histogram(harmonize.remap(view("v_votes"), view("v_codes")), "product_id", "unified")


@query("""SELECT p.product_id AS product_id, p.native AS native, count(*) AS n FROM (SELECT product_id, native + CASE WHEN pix % 11 = 0 THEN 1000 ELSE 0 END AS native FROM v_votes) p
WHERE NOT EXISTS (SELECT 1 FROM v_codes k WHERE k.product_id = p.product_id AND k.native = p.native) GROUP BY 1, 2""")
def legend_conformance(spark, view):
    votes = view("v_votes").withColumn("native", F.col("native") + F.when(F.col("pix") % 11 == 0, 1000).otherwise(0))
    return harmonize.unknown_codes(votes, view("v_codes"))


@query("""WITH b AS (SELECT a.native AS native, r.unified AS ref_class, count(*) AS n FROM v_votes a JOIN v_unified r ON r.pix = a.pix AND r.year = a.year AND r.product_id = 1 WHERE a.product_id = 2 GROUP BY 1, 2),
t AS (SELECT *, sum(n) OVER (PARTITION BY native) AS total, max(n) OVER (PARTITION BY native) AS most, first_value(ref_class) OVER (PARTITION BY native ORDER BY n DESC, ref_class) AS dominant FROM b)
SELECT native, ref_class, n, CAST(total AS BIGINT) AS row_total, dominant, round(100.0 * CAST(most AS DOUBLE) / CAST(total AS DOUBLE), 1) AS dominant_pct FROM t""")
def product_crosstab(spark, view):
    ref = view("v_unified").where("product_id = 1").select("pix", "year", F.col("unified").alias("ref_class"))
    return harmonize.crosstab(view("v_votes").where("product_id = 2").join(ref, ["pix", "year"]), "native", "ref_class")


@query("""WITH y AS (SELECT DISTINCT CAST(year(o_orderdate) - 7 + o_orderkey % 4 * 10 AS INT) AS year FROM orders), f AS (SELECT p_partkey AS file, p_partkey % 2 AS early, CASE p_partkey % 4 WHEN 1 THEN 3 WHEN 3 THEN 7 WHEN 2 THEN 23 ELSE 11 END AS bands FROM part)
SELECT file, year, CAST(CASE WHEN early = 1 AND bands = 3 THEN CASE year WHEN 1985 THEN 1 WHEN 1990 THEN 2 WHEN 1995 THEN 3 ELSE bands END
 WHEN early = 1 THEN greatest(1, least(bands, round_even(1 + (year - 1985) / 10.0::DOUBLE * (bands - 1), 0)))
 WHEN bands = 23 THEN greatest(1, least(23, year - 1999)) ELSE greatest(1, least(bands, round_even(1 + (year - 2000) / 22.0::DOUBLE * (bands - 1), 0))) END AS INT) AS band FROM y CROSS JOIN f""")
def catalog_band_lookup(spark, view):
    """The band of every file (early or late, with 3 to 23 bands) for every year that the orders hold; years are a small dimension."""
    years = view("orders").select((F.year("o_orderdate") - 7 + F.col("o_orderkey") % 4 * 10).cast("int").alias("year")).distinct()
    k = F.col("p_partkey")
    files = view("part").select(k.alias("file"), (k % 2 == 1).alias("early"), F.when(k % 4 == 1, 3).when(k % 4 == 3, 7).when(k % 4 == 2, 23).otherwise(11).alias("bands"))
    return files.crossJoin(F.broadcast(years)).select("file", "year", harmonize.band_of(F.col("year"), F.col("bands"), F.col("early")).alias("band"))


@query("""WITH f AS (SELECT 'p' || (o_custkey % 9) AS product, CAST(1990 + o_orderkey % 30 AS INT) AS year, CAST(o_orderkey % 3 AS INT) AS priority, 'tile_' || (1990 + o_orderkey % 30) || '_' || o_orderkey || '.tif' AS path FROM orders)
SELECT product, year, priority, path FROM (SELECT *, row_number() OVER (PARTITION BY product, year ORDER BY priority, path) AS rn FROM f) WHERE rn = 1""")
def catalog_resolve_files(spark, view):
    o = view("orders")
    files = o.select(F.concat(F.lit("p"), F.col("o_custkey") % 9).alias("product"), (F.col("o_orderkey") % 3).cast("int").alias("priority"), F.concat(F.lit("tile_"), F.lit(1990) + F.col("o_orderkey") % 30, F.lit("_"), "o_orderkey", F.lit(".tif")).alias("path"))
    return harmonize.resolve_files(files.withColumn("year", harmonize.year_in_name(F.col("path"))).select("product", "year", "priority", "path"))


@query("""SELECT p_brand AS variable, round(min(p_retailprice), 6) AS min, round(max(p_retailprice), 6) AS max, round(avg(p_retailprice), 6) AS mean, round(stddev_pop(p_retailprice), 6) AS std,
round(quantile_cont(p_retailprice, 0.05), 6) AS p5, round(quantile_cont(p_retailprice, 0.95), 6) AS p95, count(p_retailprice) AS n_valid, count(*) - count(p_retailprice) AS n_null FROM part GROUP BY 1""")
def describe_continuous(spark, view):
    d = harmonize.describe_continuous(view("part").withColumnRenamed("p_brand", "variable"), "p_retailprice", "variable")
    return d.select("variable", *(F.round(c, 6).alias(c) for c in ("min", "max", "mean", "std", "p5", "p95")), "n_valid", "n_null")


# -- The fusion as SQL, for the oracle.

_WIDE = "w AS (SELECT pix, year, " + ", ".join(f"min(CASE WHEN product_id = {p} THEN unified END) AS v{p}" for p in _P) + " FROM v_unified GROUP BY pix, year)"
_CELLS = "cells AS (SELECT pix, year FROM v_aoi CROSS JOIN v_anchor)"
_COUNTS = (
    "pc AS (SELECT "
    + ", ".join([f"count(*) FILTER ({_L1.format('unified')} = {k}) + 1 AS n{k}" for k in dims.L1_CLASSES] + [f"count(*) FILTER (unified = {m}) + 1 AS m{m}" for ms in dims.SUBCLASSES.values() for m in ms])
    + " FROM v_unified WHERE product_id = 1)"
)
_SUM1 = " + ".join(f"n{k}" for k in dims.L1_CLASSES)
_PRIOR = (
    "pr AS (SELECT "
    + ", ".join([f"CAST(n{k} AS DOUBLE) / ({_SUM1}) AS p{k}" for k in dims.L1_CLASSES] + [f"CAST(m{m} AS DOUBLE) / ({' + '.join(f'm{x}' for x in ms)}) AS q{m}" for ms in dims.SUBCLASSES.values() for m in ms])
    + " FROM pc)"
)


def _errors(delta: float, floor: float) -> dict[str, float]:
    """Logarithms of a right and a wrong vote by name: h<product> and s<product> of the first tier, x<group>_<product> and z<group>_<product> of the second."""
    out = {}
    for p, (_, weight, *_rest) in dims.PRODUCTS.items():
        e = dims.error_rate(weight, delta)
        out |= {f"h{p}": math.log(1 - e), f"s{p}": math.log(e / 8)}
    for g, members in dims.SUBCLASSES.items():
        for p in dims.AUTHORITIES[g]:
            e = dims.error_rate(dims.PRODUCTS[p][1], delta)
            e = max(floor, e) if p == dims.SOFT_PRODUCT else e
            out |= {f"x{g}_{p}": math.log(1 - e), f"z{g}_{p}": math.log(e / (len(members) - 1))}
    return out


def _fusion_sql(delta: float = 0.0, floor: float = dims.SUB_ERROR_FLOOR, tail: str = "", settings: dict[str, tuple[float, float]] | None = None) -> str:
    """CTEs up to ``fz``: one row for each cell with the fused class and the posteriors; with ``settings`` (name: delta and floor) one for each cell and setting."""
    said = {n: n for n in _errors(delta, floor)} if settings else {n: repr(v) for n, v in _errors(delta, floor).items()}
    u = ", ".join(f"{_L1.format(f'v{p}')} AS u{p}" for p in _P)
    logs = []
    for k in dims.L1_CLASSES:
        terms = [f"ln(p{k} + 1e-12)"]
        for p, (*_, spec) in dims.PRODUCTS.items():
            ok = f"u{p} IN ({', '.join(map(str, spec))})" if spec else f"u{p} > 0"
            terms.append(f"CASE WHEN v{p} IS NULL OR NOT ({ok}) THEN 0 WHEN u{p} = {k} THEN {said[f'h{p}']} ELSE {said[f's{p}']} END")
        logs.append(" + ".join(terms) + f" AS a{k}")
    best1 = "CASE " + " ".join(f"WHEN a{k} = m1 THEN {k}" for k in dims.L1_CLASSES) + " END"
    z1 = " + ".join(f"exp(a{k} - m1)" for k in dims.L1_CLASSES)
    subs = []
    for g, members in dims.SUBCLASSES.items():
        for m in members:
            terms = [f"ln(q{m} + 1e-12)"]
            for p in dims.AUTHORITIES[g]:
                terms.append(f"CASE WHEN v{p} = {m} THEN {said[f'x{g}_{p}']} WHEN v{p} IN ({', '.join(map(str, members))}) THEN {said[f'z{g}_{p}']} ELSE 0 END")
            subs.append(" + ".join(terms) + f" AS b{m}")
    pick = {g: "CASE " + " ".join(f"WHEN b{m} = greatest({', '.join(f'b{x}' for x in ms)}) THEN {m}" for m in ms) + " END" for g, ms in dims.SUBCLASSES.items()}
    share = {g: f"1.0 / ({' + '.join(f'exp(b{m} - greatest(' + ', '.join(f'b{x}' for x in ms) + '))' for m in ms)})" for g, ms in dims.SUBCLASSES.items()}
    direct = "CASE " + " ".join(f"WHEN map_l1 = {l} THEN {c}" for l, c in dims.L1_DIRECT.items()) + " END"
    agree = " + ".join(f"CASE WHEN u{p} = map_l1 THEN 1 ELSE 0 END" for p in _P)
    pct = lambda x: f"CAST(floor(round(least(greatest(100.0::DOUBLE * ({x}), 0.0), 100.0), 6)) AS INT)"
    by = {n: _errors(*v) for n, v in (settings or {}).items()}
    table = ", ".join("('" + n + "', " + ", ".join(map(repr, e.values())) + ")" for n, e in by.items())
    swept = f"st AS (SELECT * FROM (VALUES {table}) t(setting, {', '.join(next(iter(by.values())))}))," if by else ""
    also, from_j = ("setting, ", ", st.*") if by else ("", "")
    return f"""WITH {_WIDE}, {_CELLS}, {_COUNTS}, {_PRIOR}, {swept}
j AS (SELECT c.pix, c.year, w.* EXCLUDE (pix, year), pr.*{from_j}, {u} FROM cells c LEFT JOIN w ON w.pix = c.pix AND w.year = c.year CROSS JOIN pr{" CROSS JOIN st" if by else ""}),
l AS (SELECT *, {", ".join(logs)} FROM j), l1 AS (SELECT *, greatest({", ".join(f"a{k}" for k in dims.L1_CLASSES)}) AS m1 FROM l),
l2 AS (SELECT *, {best1} AS map_l1, 1.0 / ({z1}) AS post_l1, {", ".join(subs)} FROM l1),
l3 AS (SELECT *, CASE map_l1 WHEN 3 THEN {pick[3]} WHEN 8 THEN {pick[8]} END AS sub, CASE map_l1 WHEN 3 THEN {share[3]} WHEN 8 THEN {share[8]} ELSE 1.0 END AS post_l2 FROM l2),
fz AS (SELECT {also}pix, year, map_l1, sub, post_l1, post_l2, CAST(coalesce(sub, {direct}) AS INT) AS fused, {pct("post_l1 * post_l2")} AS conf_joint, {pct("post_l1")} AS conf_l1, {pct("post_l2")} AS conf_l2, CAST({agree} AS INT) AS agreement FROM l3)
{tail}"""


def fused(view, delta: float = 0.0, floor: float = dims.SUB_ERROR_FLOOR):
    votes = view("v_unified")
    return fusion.fuse(votes, _cells(view), fusion.priors(votes), delta, floor)


@query(f"WITH {_COUNTS}, {_PRIOR} " + " UNION ALL ".join([f"SELECT 1 AS level, {k} AS class, round(p{k}, 9) AS prior FROM pr" for k in dims.L1_CLASSES] + [f"SELECT 2, {m}, round(q{m}, 9) FROM pr" for ms in dims.SUBCLASSES.values() for m in ms]))
def fusion_priors(spark, view):
    row = fusion.priors(view("v_unified"))
    entries = [F.struct(F.lit(1).alias("level"), F.lit(k).alias("class"), F.round(f"l1_{k}", 9).alias("prior")) for k in dims.L1_CLASSES]
    entries += [F.struct(F.lit(2).alias("level"), F.lit(m).alias("class"), F.round(f"l2_{m}", 9).alias("prior")) for ms in dims.SUBCLASSES.values() for m in ms]
    return row.select(F.inline(F.array(*entries)))


@query(_fusion_sql(tail="SELECT pix, year, CAST(map_l1 AS INT) AS map_l1, conf_l1, agreement FROM fz"))
def fusion_level1(spark, view):
    return fused(view).select("pix", "year", "map_l1", "conf_l1", "agreement")


@query(_fusion_sql(tail="SELECT pix, year, CAST(sub AS INT) AS sub, conf_l2 FROM fz WHERE sub IS NOT NULL"))
def fusion_level2(spark, view):
    return fusion.subclasses(fused(view))


@query(_fusion_sql(tail="SELECT pix, year, fused, conf_joint, conf_l1, conf_l2, 100 - conf_joint AS decision_entropy, agreement FROM fz"))
def fusion_map(spark, view):
    return fused(view).select("pix", "year", "fused", "conf_joint", "conf_l1", "conf_l2", "decision_entropy", "agreement")


@query(_fusion_sql(tail="SELECT year, fused AS class, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY year), 3) AS area_pct, round(CAST(sum(conf_joint) AS DOUBLE) / count(*), 6) AS mean_conf, round(CAST(sum(agreement) AS DOUBLE) / count(*), 6) AS mean_agreement FROM fz GROUP BY year, fused"))
def fusion_class_area(spark, view):
    return fusion.class_area(fused(view))


@query(_fusion_sql(tail="SELECT CAST(CASE WHEN fused IN (1, 3) THEN 1 WHEN fused = 4 THEN 2 WHEN fused = 5 THEN 3 WHEN fused = 6 THEN 4 WHEN fused = 9 THEN 5 WHEN fused = 13 THEN 6 WHEN fused IN (11, 12) THEN 7 ELSE 8 END AS INT) AS zone, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 3) AS pct FROM fz WHERE year = 2020 GROUP BY 1"))
def zone_map(spark, view):
    from geoweave.functions.expressions import zone_of

    by = fused(view).where("year = 2020").groupBy(zone_of(F.col("fused")).alias("zone")).agg(F.count("*").alias("n"))
    return by.crossJoin(F.broadcast(by.agg(F.sum("n").alias("t")))).select("zone", "n", F.round(F.lit(100.0) * F.col("n") / F.col("t"), 3).alias("pct"))


def _year_2020(sql: str) -> str:
    """The fusion of one year only; priors are those of all years."""
    sql = sql.replace("SELECT pix, year FROM v_aoi CROSS JOIN v_anchor", "SELECT pix, 2020 AS year FROM v_aoi")
    return sql.replace("FROM v_unified GROUP BY pix, year", "FROM v_unified WHERE year = 2020 GROUP BY pix, year")


def _sensitivity_sql(floor: float) -> str:
    settings = {f"eps{floor}_dw{delta:+.2f}": (delta, floor) for delta in (-0.1, 0.0, 0.1)} | {"base": (0.0, 0.4)}
    counts = "SELECT setting, fused AS class, count(*) AS n FROM fz GROUP BY setting, fused"
    return f"""SELECT setting, round(max(dev), 3) AS max_dev, round(avg(dev), 3) AS mean_dev, round(max(dev) FILTER (class IN (3, 4, 5, 6)), 3) AS steppe_dev, round(max(dev) FILTER (class IN (11, 12, 13)), 3) AS bare_dev
FROM (SELECT setting, class, abs(pct - max(pct) FILTER (setting = 'base') OVER (PARTITION BY class)) AS dev FROM (SELECT setting, class, round(100.0::DOUBLE * n / sum(n) OVER (PARTITION BY setting), 6) AS pct FROM ({_year_2020(_fusion_sql(tail=counts, settings=settings))})))
WHERE dev IS NOT NULL AND setting <> 'base' GROUP BY setting"""


# The sweep of three floors and three weight changes, a floor a query.


def _sensitivity(view, floor: float):
    cells = view("v_aoi").withColumn("year", F.lit(2020))
    out = fusion.sensitivity(view("v_unified"), cells, fusion.priors(view("v_unified")), floors=tuple(sorted({0.4, floor})))
    return out.where(F.col("setting").startswith(f"eps{floor}_"))


@query(_sensitivity_sql(0.4))
def fusion_sensitivity(spark, view):
    return _sensitivity(view, 0.4)


@query(_sensitivity_sql(0.3))
def fusion_sensitivity_low_floor(spark, view):
    return _sensitivity(view, 0.3)


@query(_sensitivity_sql(0.5))
def fusion_sensitivity_high_floor(spark, view):
    return _sensitivity(view, 0.5)

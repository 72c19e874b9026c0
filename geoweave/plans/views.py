"""Views that give the driver's tables the shape of grids, votes and series.

Each view is one SQL text that both Spark and the oracle run: ``{name}`` stands for a table
or view, ``{div}`` for integer division. They are input for the operators, not operators. Spark
makes the rows of ``v_votes`` in another way (:func:`_votes`), which a test holds against its SQL.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoweave.functions import dims

TABLES = ("customer", "supplier", "part", "orders", "lineitem", "events", "nation", "region", "labels", "embeddings", "documents")


def _values(rows: list[tuple], names: str) -> str:
    body = ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({names})"


_CODES = [(p, k, n, u) for p, codes in dims.CROSSWALK.items() for k, (n, u) in enumerate(sorted(codes.items()))]
_COUNTS = [(p, len(codes)) for p, codes in dims.CROSSWALK.items()]
_YEARS = [(p, y) for p in dims.PRODUCTS for y in dims.ANCHORS if dims.available(p, y)]
_MONTH = "CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1 AS INT)"

#: Yearly layers on the site grid: (variable, first year, years, step).
_LAYERS = [
    ("CDD", 1985, 36, 1), ("Rx1day", 1985, 34, 1), ("TXx", 1986, 30, 1),
    ("ndvi_annual_mean", 2001, 22, 1), ("ndvi_gs_mean", 2001, 22, 1), ("ndvi_gs_max", 2001, 22, 1),
    ("sos", 2001, 20, 1), ("eos", 2001, 20, 1), ("los", 2003, 9, 2),
    ("graz_total", 2000, 6, 3), ("graz_cattle", 2000, 6, 3), ("graz_sheep", 2001, 5, 4),
    ("cropping", 2001, 19, 1), ("popdens", 2000, 21, 1), ("glw", 2010, 2, 10),
    ("spei03_annual_mean", 1990, 30, 1), ("spei12_annual_min", 1990, 30, 1),
    *((v, 1982 + k % 4, 36 - k, 1) for k, v in enumerate(("CWD", "GSL", "R10", "R20", "Rx5day", "Tn10p", "Tn90p", "TNn", "TNx", "Tx10p", "Tx90p", "TXn"))),
    *((f"{s}_{v}", 1990, 30 + k, 1) for s in ("spei03", "spei06", "spei12") for k, v in enumerate(("annual_mean", "gs_mean", "annual_min", "annual_max", "n_severe_drought", "n_severe_wet")) if (s, v) not in (("spei03", "annual_mean"), ("spei12", "annual_min"))),
    ("graz_goat", 2000, 6, 3), ("graz_bigl", 2001, 5, 4),
]
#: Rasters: (group, variable, year, factor, shift).
_BANDS = [
    ("climate", "CDD", 2000, 9.5, 0.0), ("climate", "Rx1day", 2000, 25.0, -40.0), ("climate", "TNn", 2005, 4.0, -110.0),
    ("grazing", "graz_total", 2000, 3.5, 1.0), ("grazing", "graz_goat", 2000, 0.5, 0.0), ("grazing", "graz_total", 2006, 2.0, 0.0),
    ("phenology", "sos", 2001, 8.0, -20.0), ("phenology", "eos", 2001, 8.0, 10.0),
    ("population", "popdens", 2000, 12.0, 0.0), ("population", "popdens", 2010, 13.0, 0.0),
    ("cropping", "cropping_intensity", 2001, 1.0, 0.0), ("cropping", "cropping_intensity", 2002, 1.0, 0.0),
    ("livestock", "glw_density", 2010, 1.5, 0.0), ("livestock", "glw_density", 2020, 1.25, 0.5),
]

VIEWS: dict[str, str] = {
    "v_anchor": _values(list(enumerate(dims.ANCHORS)), "idx, year"),
    "v_codes": _values(_CODES, "product_id, k, native, unified"),
    "v_code_counts": _values(_COUNTS, "product_id, n"),
    "v_available": _values(_YEARS, "product_id, year"),
    "v_legend": _values([(c, n) for c, n in dims.LEGEND.items() if c], "class, name"),
    "v_grid": "SELECT o_orderkey AS pix, CAST(o_orderkey {div} 125 AS INT) AS r, CAST(o_orderkey % 125 AS INT) AS c, CAST((o_orderkey % 125 - 62) * 10000 AS DOUBLE) AS x, CAST(5900000 - (o_orderkey {div} 125) * 10000 AS DOUBLE) AS y FROM {orders}",
    "v_aoi": "SELECT o_orderkey AS pix FROM {orders} WHERE o_orderpriority <> '5-LOW'",
    "v_votes": """
        SELECT l_orderkey AS pix, a.year AS year, n.product_id AS product_id, min(k.native) AS native
        FROM {lineitem} CROSS JOIN {v_anchor} a
        JOIN {v_code_counts} n ON n.product_id = l_linenumber
        JOIN {v_available} v ON v.product_id = n.product_id AND v.year = a.year
        JOIN {v_codes} k ON k.product_id = n.product_id AND k.k = (l_partkey * 7 + l_suppkey + a.idx * (CAST(floor(l_quantity) AS INT) % 3)) % n.n
        WHERE l_linenumber <= 7
        GROUP BY l_orderkey, a.year, n.product_id
        UNION ALL
        SELECT o_orderkey, year, 8, CASE WHEN o_custkey % 3 = 0 THEN 1 ELSE 0 END FROM {orders} CROSS JOIN {v_anchor}""",
    "v_unified": """
        SELECT v.pix AS pix, v.year AS year, v.product_id AS product_id, coalesce(k.unified, 0) AS unified
        FROM {v_votes} v JOIN {v_aoi} a ON a.pix = v.pix
        LEFT JOIN {v_codes} k ON k.product_id = v.product_id AND k.native = v.native""",
    # The first product's classes, filled up by a class from the key, as a dense map of every cell and year.
    "v_map": """
        SELECT g.pix AS pix, g.year AS year, CASE WHEN coalesce(u.unified, 0) > 0 THEN u.unified ELSE CAST((g.pix * 7 + 3) % 15 AS INT) END AS class, CAST(60 + (g.pix * 13 + g.idx * (g.pix % 5)) % 41 AS INT) AS conf
        FROM (SELECT pix, year, idx FROM {v_aoi} CROSS JOIN {v_anchor}) g
        LEFT JOIN (SELECT * FROM {v_unified} WHERE product_id = 1) u ON u.pix = g.pix AND u.year = g.year""",
    "v_class2020": "SELECT g.pix AS pix, g.r AS r, g.c AS c, g.x AS x, g.y AS y, m.class AS class FROM {v_grid} g JOIN {v_map} m ON m.pix = g.pix AND m.year = 2020",
    "v_pairs": "SELECT a.pix AS pix, a.year AS from_year, b.year AS to_year, a.class AS from_class, b.class AS to_class, a.conf AS conf_from, b.conf AS conf_to FROM {v_map} a JOIN {v_map} b ON a.pix = b.pix AND b.year = a.year + 5",
    "v_transitions": "SELECT from_year, from_class, to_class, count(*) AS n FROM {v_pairs} WHERE from_class > 0 AND to_class > 0 GROUP BY from_year, from_class, to_class",
    "v_points": "SELECT m.pix AS pix, m.class AS mapped, CAST(u.unified AS INT) AS reference FROM {v_map} m JOIN {v_unified} u ON u.pix = m.pix AND u.year = m.year AND u.product_id = 2 WHERE m.year = 2020",
    "v_months": f"SELECT c_mktsegment AS zone, {_MONTH} AS t, CAST(sum(CAST(o_totalprice AS DECIMAL(14,2))) AS DOUBLE) / count(*) / 100000 AS ndvi FROM {{orders}} JOIN {{customer}} ON c_custkey = o_custkey GROUP BY c_mktsegment, {_MONTH}",
    "v_series": """
        SELECT m.zone AS zone, m.t AS t, m.ndvi AS ndvi, d.discount AS discount, d.quantity AS quantity, d.price AS price
        FROM {v_months} m JOIN (
            SELECT c_mktsegment AS zone, CAST((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS INT) AS t,
                   CAST(sum(CAST(l_discount AS DECIMAL(6,4))) AS DOUBLE) / count(*) AS discount, CAST(sum(CAST(l_quantity AS DECIMAL(8,2))) AS DOUBLE) / count(*) AS quantity, CAST(sum(CAST(l_extendedprice AS DECIMAL(14,2))) AS DOUBLE) / count(*) AS price
            FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey JOIN {customer} ON c_custkey = o_custkey
            GROUP BY c_mktsegment, CAST((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS INT)) d
        ON d.zone = m.zone AND d.t = m.t""",
    "v_monthly": "SELECT o_custkey AS pixel, CAST(year(o_orderdate) AS INT) AS year, CAST(month(o_orderdate) AS INT) AS month, (o_totalprice - 250000) / 100000.0 AS z FROM {orders}",
    "v_annual": """
        SELECT l_suppkey AS entity, CAST(year(l_shipdate) AS INT) AS year,
               CASE WHEN l_suppkey % 7 = 0 AND year(l_shipdate) = 1998 THEN NULL ELSE CAST(sum(CAST(l_extendedprice AS DECIMAL(14,2))) AS DOUBLE) / count(*) END AS value
        FROM {lineitem} GROUP BY l_suppkey, year(l_shipdate)""",
    "v_cells": "SELECT g.r AS r, g.c AS c, o.o_totalprice AS value, m.class AS class FROM {v_grid} g JOIN {orders} o ON o.o_orderkey = g.pix LEFT JOIN {v_class2020} m ON m.pix = g.pix",
    "v_gaps": "SELECT r, c, CASE WHEN (r * 31 + c * 17) % 5 < 2 THEN NULL ELSE value END AS value FROM {v_cells}",
    "v_blocks": "SELECT CAST(r {div} 3 AS INT) AS br, CAST(c {div} 3 AS INT) AS bc, r, c, value, class FROM {v_cells}",
    "v_rect": "SELECT CAST(n_nationkey % 5 * 25 AS INT) AS c0, CAST(n_nationkey % 5 * 25 + 25 AS INT) AS c1, CAST(n_nationkey {div} 5 * 24 AS INT) AS r0, CAST(n_nationkey {div} 5 * 24 + 24 AS INT) AS r1, n_regionkey + 1 AS code, n_nationkey AS seq FROM {nation}",
    "v_roads": "SELECT g.r AS r, g.c AS c FROM {v_grid} g JOIN {orders} o ON o.o_orderkey = g.pix WHERE o.o_orderpriority = '1-URGENT' AND o.o_custkey % 50 = 0",
    "v_raster": "SELECT CAST(p_partkey {div} 50 AS INT) AS r, CAST(p_partkey % 50 AS INT) AS c, CAST(p_size AS INT) AS code, p_retailprice AS value FROM {part}",
    # A small site grid, and yearly layers of the driver variables on it, with years and cells missing.
    "v_site": "SELECT s_suppkey AS pix, CAST(s_suppkey {div} 20 AS INT) AS r, CAST(s_suppkey % 20 AS INT) AS c, CAST((s_suppkey % 20 - 10) * 40000 + 20000 AS DOUBLE) AS x, CAST(4300000 - (s_suppkey {div} 20) * 40000 AS DOUBLE) AS y FROM {supplier}",
    "v_layer": _values([(k, *row) for k, row in enumerate(_LAYERS)], "k, variable, first, n, step"),
    "v_driver": """
        SELECT l_suppkey AS pix, d.variable AS variable, CAST(d.first + d.step * ((l_partkey * 7 + l_orderkey) % d.n) AS INT) AS year,
               CASE WHEN (l_suppkey * 3 + d.k + (l_partkey * 7 + l_orderkey) % d.n) % 13 = 0 THEN NULL ELSE CAST(sum(CAST(l_quantity AS DECIMAL(8,2))) AS DOUBLE) / count(*) END AS value
        FROM {lineitem} JOIN {v_layer} d ON d.k = (l_partkey + l_linenumber * 5) % """ + str(len(_LAYERS)) + """
        GROUP BY l_suppkey, d.variable, d.k, CAST(d.first + d.step * ((l_partkey * 7 + l_orderkey) % d.n) AS INT), (l_suppkey * 3 + d.k + (l_partkey * 7 + l_orderkey) % d.n) % 13""",
    "v_target": "SELECT s.pix AS pix, a.year AS year, s.r AS r, s.c AS c, CAST((s.pix * 7 + a.idx * (s.pix % 4)) % 15 AS INT) AS class, CAST(60 + (s.pix * 13 + a.idx) % 41 AS INT) AS conf_joint, CAST(60 + (s.pix * 17 + a.idx) % 41 AS INT) AS conf_l1, CAST(100 - s.pix % 3 AS INT) AS conf_l2, CAST((s.pix + a.idx) % 8 AS INT) AS agreement_count FROM {v_site} s CROSS JOIN {v_anchor} a",
    # Rasters of several variables and years on the cells of v_raster.
    "v_band": _values(_BANDS, "grp, variable, year, factor, shift"),
    "v_bands": "SELECT b.grp AS grp, b.variable AS variable, b.year AS year, r.r AS r, r.c AS c, CASE WHEN (r.r + r.c + b.year) % 17 = 0 THEN NULL WHEN b.grp = 'population' AND (r.r * 3 + r.c) % 19 = 0 THEN CAST(-99999 AS DOUBLE) WHEN b.grp = 'cropping' AND (r.r + r.c) % 7 = 0 THEN CAST(255 AS DOUBLE) WHEN b.grp = 'cropping' THEN CAST(r.code % 4 AS DOUBLE) ELSE CAST(r.code AS DOUBLE) * b.factor + b.shift END AS value FROM {v_raster} r CROSS JOIN {v_band} b",
    # Triangles on the main grid: the edges of polygons with a code, an order and a day.
    "v_triangle": "SELECT n_nationkey AS poly, CAST(n_nationkey % 5 * 23 AS DOUBLE) + 0.3 AS x, CAST(n_nationkey {div} 5 * 22 AS DOUBLE) + 0.6 AS y, n_regionkey + 1 AS code, (n_nationkey * 7) % 25 AS seq, CAST(2000 + n_nationkey % 3 AS INT) AS year, CAST(n_nationkey % 4 AS INT) AS day FROM {nation}",
    "v_edge": "SELECT poly, x AS x1, y AS y1, x + 27.4 AS x2, y + 3.2 AS y2 FROM {v_triangle} UNION ALL SELECT poly, x + 27.4, y + 3.2, x + 6.1, y + 25.5 FROM {v_triangle} UNION ALL SELECT poly, x + 6.1, y + 25.5, x, y FROM {v_triangle}",
    "v_nodes": """
        SELECT br * 1000 + bc AS node, br, bc, CAST(sum(CAST(value AS DECIMAL(14,2))) AS DOUBLE) / count(*) / 100000 AS value
        FROM {v_blocks} WHERE bc < 41 GROUP BY br, bc HAVING count(*) = 9""",
}

#: Tables that Spark deals by a key before a view multiplies or groups their rows: groups and joins by that key and more need no other exchange.
DEALT = {"v_votes": {"lineitem": "l_orderkey", "orders": "o_orderkey"}, "v_driver": {"lineitem": "l_suppkey"}}
#: Rows of a dealt table for each task.
TASK_ROWS = 200_000


def tasks(df: DataFrame, rows: int = TASK_ROWS) -> int:
    """Number of tasks for a table, so that what one of them holds does not grow with it, and no core is idle.

    Groups and joins behind a shuffle take memory by rows, but adaptive execution joins partitions by their compressed bytes, down to one
    for each core; tables are therefore dealt by number."""
    least = min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * df.sparkSession.sparkContext.defaultParallelism)
    return max(least, df.count() // rows + 1)


def _votes(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """The rows of the SQL of ``v_votes``, from tables dealt by their keys. Lines are grouped once for all years instead of once for each, and
    codes are looked up in constant arrays instead of joined."""
    by = {p: sorted(n for q, _, n, _ in _CODES if q == p) for p in range(1, 8)}
    codes = F.array(*(F.array(*map(F.lit, by[p])) for p in range(1, 8)))
    own = F.get(codes, F.col("l_linenumber") - 1)
    place, step = F.col("l_partkey") * 7 + F.col("l_suppkey"), F.floor("l_quantity").cast("int") % 3
    years = list(enumerate(dims.ANCHORS))
    native = [F.when(F.col("l_linenumber").isin(*[p for p, y in _YEARS if y == year]), F.get(own, (place + step * idx) % F.size(own))).alias(f"_{year}") for idx, year in years]
    lines = lineitem.where("l_linenumber BETWEEN 1 AND 7").select(F.col("l_orderkey").alias("pix"), F.col("l_linenumber").cast("int").alias("product_id"), *native)
    least = lines.groupBy("pix", "product_id").agg(*(F.min(f"_{y}").alias(f"_{y}") for _, y in years))
    voted = least.select("pix", "product_id", F.inline(F.array(*(F.struct(F.lit(y).alias("year"), F.col(f"_{y}").alias("native")) for _, y in years)))).where("native IS NOT NULL")
    masks = orders.select(F.col("o_orderkey").alias("pix"), F.explode(F.array(*(F.lit(y) for _, y in years))).alias("year"), F.lit(8).alias("product_id"), F.when(F.col("o_custkey") % 3 == 0, 1).otherwise(0).alias("native"))
    return voted.select("pix", "year", "product_id", "native").unionAll(masks)


def spark_view(spark: SparkSession, sf_dir: str, name: str, held: dict[str, DataFrame] | None = None) -> DataFrame:
    """A table or view over the Parquet files of ``sf_dir``."""
    held = {} if held is None else held
    if name not in held:
        if name in TABLES:
            held[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        else:
            needs = sorted(set(re.findall(r"\{(\w+)\}", VIEWS[name])) - {"div"})
            given = {n: spark_view(spark, sf_dir, n, held) for n in needs}
            if name in DEALT:  # by number, as the rows are multiplied behind the exchange, where Spark would join small partitions
                parts = tasks(given["lineitem"])
                given |= {n: given[n].repartition(parts, key) for n, key in DEALT[name].items()}
            held[name] = _votes(given["lineitem"], given["orders"]) if name == "v_votes" else spark.sql(VIEWS[name].replace("{div}", "div"), **given)
    return held[name]


def oracle(body: str) -> str:
    """SQL for the oracle: the body after definitions of the views that it names."""
    order: list[str] = []

    def need(text: str) -> None:
        for n in dict.fromkeys(re.findall(r"\b(v_\w+)\b", text)):
            if n in VIEWS and n not in order:
                need(VIEWS[n])
                order.append(n)

    need(body)
    views = [f"{n} AS ({re.sub(r'{(\w+)}', lambda m: '//' if m[1] == 'div' else m[1], VIEWS[n])})" for n in order]
    body = body.strip()
    if body.upper().startswith("WITH "):
        return "WITH " + ", ".join([*views, body[5:]])
    return ("WITH " + ", ".join(views) + "\n" if views else "") + body

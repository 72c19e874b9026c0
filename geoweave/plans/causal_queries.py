"""Queries of causality screens, graphs and attributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoweave.functions.expressions import feature_group, is_autocorrelated
from geoweave.operators import boosting, causal, evaluate, features, forests, graph, grid, models, networks
from geoweave.plans.registry import query
from geoweave.sources import catalog

_DRIVERS = ("discount", "quantity", "price")
_LAGS = tuple(range(-4, 5))


@query("SELECT zone, t, round(ndvi, 9) AS ndvi, round(discount, 9) AS discount, round(quantity, 9) AS quantity, round(price, 6) AS price FROM v_series")
def zone_series(spark, view):
    return view("v_series").select("zone", "t", *(F.round(c, 9).alias(c) for c in ("ndvi", "discount", "quantity")), F.round("price", 6).alias("price"))


@query("SELECT c_mktsegment AS zone, CAST(year(o_orderdate) AS INT) AS year, round(CAST(sum(CAST(o_totalprice AS DECIMAL(14,2))) AS DOUBLE) / count(*), 4) AS value, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2")
def regional_series(spark, view):
    rows = view("orders").join(view("customer"), F.col("c_custkey") == F.col("o_custkey"))
    return grid.zone_means(rows.withColumn("year", F.year("o_orderdate")).withColumn("zone", F.col("c_mktsegment")), "o_totalprice", "zone", "year").select("zone", "year", F.round("value", 4).alias("value"), "n")


_EMBED = """e AS (SELECT * FROM (SELECT *, ndvi AS x0, lag(ndvi, 1) OVER w AS x1, lag(ndvi, 2) OVER w AS x2 FROM v_series WINDOW w AS (PARTITION BY zone ORDER BY t)) WHERE x2 IS NOT NULL)"""


@query(f"WITH {_EMBED} SELECT zone, t, round(x0, 9) AS x0, round(x1, 9) AS x1, round(x2, 9) AS x2 FROM e")
def takens_embedding(spark, view):
    return causal.embed(view("v_series"), "ndvi", "t", ["zone"]).select("zone", "t", *(F.round(f"x{j}", 9).alias(f"x{j}") for j in range(3)))


_SIMPLEX = f"""{_EMBED}, d AS (SELECT a.zone, a.t, a.price AS y, b.t AS tl, b.price AS yl, sqrt((a.x0 - b.x0) * (a.x0 - b.x0) + (a.x1 - b.x1) * (a.x1 - b.x1) + (a.x2 - b.x2) * (a.x2 - b.x2)) AS d FROM e a JOIN e b ON a.zone = b.zone AND a.t <> b.t),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY zone, t ORDER BY d, tl) AS rn FROM d) WHERE rn <= 4),
s AS (SELECT zone, t, any_value(y) AS observed, sum(exp(-d / greatest(m, 1e-12)) * yl) / sum(exp(-d / greatest(m, 1e-12))) AS estimate FROM (SELECT *, min(d) OVER (PARTITION BY zone, t) AS m FROM k) GROUP BY 1, 2 HAVING count(*) = 4)"""


def _manifold(view):
    return causal.embed(view("v_series"), "ndvi", "t", ["zone"]).withColumn("target", F.col("price"))


@query(f"WITH {_SIMPLEX} SELECT zone, t, round(observed, 3) AS observed, round(estimate, 3) AS estimate FROM s")
def simplex_crossmap(spark, view):
    m = _manifold(view)
    return causal.simplex(m, m, ["zone"]).select("zone", "t", F.round("observed", 3).alias("observed"), F.round("estimate", 3).alias("estimate"))


@query(f"WITH {_SIMPLEX} SELECT zone, round(corr(observed, estimate), 6) AS rho, count(*) AS n FROM s GROUP BY 1")
def ccm_full_library(spark, view):
    return causal.ccm_full(view("v_series"), "price", "ndvi", ["zone"]).select("zone", F.round("rho", 6).alias("rho"), "n")


@query(f"WITH {_SIMPLEX}, g AS (SELECT * FROM (VALUES {', '.join(f'({k})' for k in _LAGS)}) t(lag)) SELECT s.zone AS zone, lag, round(corr(v.price, estimate), 6) AS rho, count(*) AS n FROM s CROSS JOIN g JOIN v_series v ON v.zone = s.zone AND v.t = s.t + lag GROUP BY 1, 2")
def ccm_lagged_full(spark, view):
    return causal.ccm_lagged(view("v_series"), "price", "ndvi", ["zone"], _LAGS).select("zone", "lag", F.round("rho", 6).alias("rho"), "n")


@query(f"WITH {_SIMPLEX}, g AS (SELECT * FROM (VALUES {', '.join(f'({k})' for k in _LAGS)}) t(lag)), r AS (SELECT s.zone AS zone, lag, corr(v.price, estimate) AS rho FROM s CROSS JOIN g JOIN v_series v ON v.zone = s.zone AND v.t = s.t + lag GROUP BY 1, 2) SELECT zone, lag AS best_lag, round(rho, 6) AS best_lag_rho FROM (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY rho DESC, lag) AS rn FROM r) WHERE rn = 1")
def ccm_best_lag(spark, view):
    lagged = causal.ccm_lagged(view("v_series"), "price", "ndvi", ["zone"], _LAGS)
    return causal.best_lag(lagged, ["zone"]).select("zone", "best_lag", F.round("best_lag_rho", 6).alias("best_lag_rho"))


def _granger_sql(driver: str) -> str:
    return f"""SELECT zone, '{driver}' AS driver, n, r2 * (n - 3) / (1 - r2) AS f FROM (SELECT zone, n, (yb - ya * ab) * (yb - ya * ab) / ((1 - ya * ya) * (1 - ab * ab)) AS r2 FROM (SELECT zone, count(*) AS n, corr(y, a) AS ya, corr(y, b) AS yb, corr(a, b) AS ab
FROM (SELECT zone, ndvi AS y, lag(ndvi) OVER w AS a, lag({driver}) OVER w AS b FROM v_series WINDOW w AS (PARTITION BY zone ORDER BY t)) WHERE a IS NOT NULL GROUP BY zone))"""


_GRANGER = " UNION ALL ".join(_granger_sql(d) for d in _DRIVERS)


def _granger(view):
    parts = [causal.granger_lag1(view("v_series"), "ndvi", d, ["zone"]).withColumn("driver", F.lit(d)) for d in _DRIVERS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"SELECT zone, driver, n, round(f, 6) AS f_stat FROM ({_GRANGER})")
def granger_lag1_f(spark, view):
    return _granger(view).select("zone", "driver", "n", F.round("f_stat", 6).alias("f_stat"))


_P = "SELECT o_orderkey AS test, CASE WHEN o_orderkey % 10 <> 3 THEN CAST((o_orderkey * 7919) % 99991 + 1 AS DOUBLE) / 100000 END AS p_value FROM orders"


@query(f"""WITH p AS ({_P}), r AS (SELECT *, row_number() OVER (ORDER BY p_value, test) AS k, count(*) OVER () AS n FROM p WHERE p_value IS NOT NULL),
q AS (SELECT test, round(least(1.0, min(p_value * n / k) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 9) AS q_value FROM r) SELECT p.test AS test, q_value FROM p LEFT JOIN q ON q.test = p.test""")
def bh_qvalues(spark, view):
    k = F.col("o_orderkey")
    p = view("orders").select(k.alias("test"), F.when(k % 10 != 3, ((k * 7919) % 99991 + 1).cast("double") / 100000).alias("p_value"))
    return causal.benjamini_hochberg(p).select("test", F.round("q_value", 9).alias("q_value"))


_PAIRS = "SELECT s_suppkey % 20 AS zone, s_nationkey AS driver, CAST(min(s_suppkey * 37 % 1000) AS DOUBLE) / 8000 AS p_value, CAST(max(s_suppkey * 91 % 1000) AS DOUBLE) / 1000 AS rho, CAST(max(s_suppkey * 17 % 100) AS DOUBLE) / 400 AS convergence FROM supplier GROUP BY 1, 2"


@query(f"SELECT zone, driver, p_value, rho, convergence FROM ({_PAIRS}) WHERE p_value < 0.05 AND rho > 0.3 AND convergence > 0.05")
def consensus_links(spark, view):
    return _consensus(view)


def _tests(view):
    k = F.col("s_suppkey")
    return view("supplier").groupBy((k % 20).alias("zone"), F.col("s_nationkey").alias("driver")).agg((F.min(k * 37 % 1000).cast("double") / 8000).alias("p_value"), (F.max(k * 91 % 1000).cast("double") / 1000).alias("rho"), (F.max(k * 17 % 100).cast("double") / 400).alias("convergence"))


def _consensus(view):
    t = _tests(view)
    return causal.consensus(t.select("zone", "driver", "p_value"), t.select("zone", "driver", "rho", "convergence"), ["zone", "driver"])


@query(f"""WITH t AS ({_PAIRS}), z AS (SELECT DISTINCT zone FROM t), d AS (SELECT DISTINCT driver FROM t)
SELECT z.zone AS zone, d.driver AS driver, round(-log10(greatest(t.p_value, 1e-6)), 6) AS strength, coalesce(t.p_value < 0.05 AND t.rho > 0.3 AND t.convergence > 0.05, false) AS link FROM z CROSS JOIN d LEFT JOIN t ON t.zone = z.zone AND t.driver = d.driver""")
def consensus_matrix(spark, view):
    t = _tests(view)
    out = causal.link_table(t.select("zone").distinct(), t.select("driver").distinct(), t, _consensus(view), ["zone", "driver"])
    return out.select("zone", "driver", F.round("strength", 6).alias("strength"), "link")


@query("""SELECT pix, CAST(CASE WHEN greatest(a, b, c) > 0.2 THEN CASE greatest(a, b, c) WHEN a THEN 1 WHEN b THEN 2 ELSE 3 END ELSE 0 END AS INT) AS dominant FROM (SELECT o_orderkey AS pix, CASE WHEN o_orderkey % 7 > 0 THEN CAST(o_orderkey % 10 AS DOUBLE) / 10 END AS a, CAST(o_orderkey % 9 AS DOUBLE) / 10 AS b, CASE WHEN o_orderkey % 5 > 1 THEN CAST(o_orderkey % 11 AS DOUBLE) / 10 END AS c FROM orders)""")
def dominant_driver(spark, view):
    return grid.dominant(_scores(view), ("a", "b", "c"), 0.2).select("pix", "dominant")


def _scores(view):
    k = F.col("o_orderkey")
    v = lambda n: (k % n).cast("double") / 10
    return view("orders").select(k.alias("pix"), F.when(k % 7 > 0, v(10)).alias("a"), v(9).alias("b"), F.when(k % 5 > 1, v(11)).alias("c"), (k % 6).alias("zone"))


@query("""WITH s AS (SELECT o_orderkey % 6 AS zone, CASE WHEN o_orderkey % 7 > 0 THEN CAST(o_orderkey % 10 AS DOUBLE) / 10 END AS a, CAST(o_orderkey % 9 AS DOUBLE) / 10 AS b, CASE WHEN o_orderkey % 5 > 1 THEN CAST(o_orderkey % 11 AS DOUBLE) / 10 END AS c FROM orders),
d AS (SELECT *, CASE greatest(a, b, c) WHEN a THEN 1 WHEN b THEN 2 ELSE 3 END AS dom FROM s)
SELECT zone, count(*) AS n_pixels, round(avg(a), 6) AS mean_a, round(avg(b), 6) AS mean_b, round(avg(c), 6) AS mean_c, round(100.0::DOUBLE * count(*) FILTER (dom = 1) / count(*), 2) AS share_a, round(100.0::DOUBLE * count(*) FILTER (dom = 2) / count(*), 2) AS share_b, round(100.0::DOUBLE * count(*) FILTER (dom = 3) / count(*), 2) AS share_c FROM d GROUP BY 1""")
def zone_summary(spark, view):
    return grid.zone_summary(grid.dominant(_scores(view), ("a", "b", "c")), "zone", ("a", "b", "c"), "dominant")


# Graph.

_EDGES = "ed AS (SELECT a.node AS src, b.node AS dst FROM v_nodes a JOIN v_nodes b ON abs(a.br - b.br) <= 1 AND abs(a.bc - b.bc) <= 1 AND a.node <> b.node AND (b.br > a.br OR b.br = a.br AND b.bc > a.bc))"
_ADJ = f"{_EDGES}, fu AS (SELECT src, dst FROM ed UNION ALL SELECT dst, src FROM ed UNION ALL SELECT node, node FROM v_nodes), dg AS (SELECT src, count(*) AS d FROM fu GROUP BY 1), ad AS (SELECT fu.src, fu.dst, 1.0::DOUBLE / sqrt(a.d * b.d) AS w FROM fu JOIN dg a ON a.src = fu.src JOIN dg b ON b.src = fu.dst)"


def _graph(view):
    nodes = view("v_nodes")
    return nodes, graph.queen_edges(nodes)


@query(f"WITH {_EDGES} SELECT src, dst FROM ed")
def queen_edges(spark, view):
    return _graph(view)[1]


@query(f"WITH {_ADJ} SELECT src, dst, round(w, 9) AS w FROM ad")
def normalized_adjacency(spark, view):
    return graph.normalised_adjacency(*_graph(view)).withColumn("w", F.round("w", 9))


@query(f"WITH {_ADJ}, h AS (SELECT ad.src AS node, sum(w * value) AS s, sum(w * value * value) AS q FROM ad JOIN v_nodes n ON n.node = ad.dst GROUP BY 1) SELECT node, round(s * 0.5 + q * -0.25 + 0.1, 6) AS h0, round(s * 1.5 + q * 0.75 + -0.2, 6) AS h1 FROM h")
def graph_conv(spark, view):
    nodes, edges = _graph(view)
    values = nodes.withColumn("square", F.col("value") * F.col("value"))
    out = graph.convolve(graph.normalised_adjacency(nodes, edges), values, ["value", "square"], [[0.5, 1.5], [-0.25, 0.75]], [0.1, -0.2])
    return out.select("node", *(F.round(f"h{k}", 6).alias(f"h{k}") for k in range(2)))


@query(f"WITH {_EDGES}, bo AS (SELECT src, dst FROM ed UNION ALL SELECT dst, src FROM ed) SELECT n.node AS node, round(coalesce(m, 0), 6) AS nbr_value FROM v_nodes n LEFT JOIN (SELECT src, avg(value) AS m FROM bo JOIN v_nodes v ON v.node = bo.dst GROUP BY 1) a ON a.src = n.node")
def neighbour_mean(spark, view):
    nodes, edges = _graph(view)
    return graph.neighbour_mean(nodes, edges, ["value"]).select("node", F.round("nbr_value", 6).alias("nbr_value"))


@query(f"WITH {_ADJ}, h AS (SELECT ad.src AS node, sum(w * value) AS s FROM ad JOIN v_nodes n ON n.node = ad.dst GROUP BY 1) SELECT h.node AS node, round(abs((s * 0.5 + 0.1) - (value * 0.5 + 0.1)), 6) AS influence FROM h JOIN v_nodes n ON n.node = h.node")
def influence_map(spark, view):
    nodes, edges = _graph(view)
    out = graph.influence(graph.normalised_adjacency(nodes, edges), nodes, nodes, ["value"], [[0.5]], [0.1])
    return out.select("node", F.round("influence", 6).alias("influence"))


@query(f"""WITH {_ADJ}, s1 AS (SELECT n.node, n.value * 0.6 + m.s * 0.3 + 0.05 AS value FROM v_nodes n JOIN (SELECT ad.src, sum(w * value) AS s FROM ad JOIN v_nodes v ON v.node = ad.dst GROUP BY 1) m ON m.src = n.node),
s2 AS (SELECT n.node, n.value * 0.6 + m.s * 0.3 + 0.05 AS value FROM s1 n JOIN (SELECT ad.src, sum(w * value) AS s FROM ad JOIN s1 v ON v.node = ad.dst GROUP BY 1) m ON m.src = n.node),
s3 AS (SELECT n.node, n.value * 0.6 + m.s * 0.3 + 0.05 AS value FROM s2 n JOIN (SELECT ad.src, sum(w * value) AS s FROM ad JOIN s2 v ON v.node = ad.dst GROUP BY 1) m ON m.src = n.node)
SELECT node, CAST(1 AS INT) AS step, round(value, 6) AS value FROM s1 UNION ALL SELECT node, 2, round(value, 6) FROM s2 UNION ALL SELECT node, 3, round(value, 6) FROM s3""")
def forecast_roll_out(spark, view):
    nodes, edges = _graph(view)
    return graph.roll_out(nodes, graph.normalised_adjacency(nodes, edges), 0.6, 0.3, 0.05, 3).withColumn("value", F.round("value", 6))


@query("""WITH p AS (SELECT zone, t, ndvi, lag(ndvi) OVER w AS a, (lag(ndvi) OVER w + lag(ndvi, 2) OVER w) / 2 AS f FROM v_series WINDOW w AS (PARTITION BY zone ORDER BY t)), q AS (SELECT * FROM p WHERE f IS NOT NULL)
SELECT count(*) AS n, round(sqrt(avg((ndvi - f) * (ndvi - f))), 6) AS rmse, round(1 - sum((ndvi - f) * (ndvi - f)) / (var_pop(ndvi) * count(*)), 6) AS r2, round(1 - sum((ndvi - a) * (ndvi - a)) / (var_pop(ndvi) * count(*)), 6) AS persistence_r2, round(1 - sum((ndvi - f) * (ndvi - f)) / sum((ndvi - a) * (ndvi - a)), 6) AS skill FROM q""")
def persistence_skill(spark, view):
    from pyspark.sql import Window

    rows = graph.persistence(view("v_series"), "zone", "t", "ndvi")
    rows = rows.withColumn("predicted", (F.col("persisted") + F.lag("ndvi", 2).over(Window.partitionBy("zone").orderBy("t"))) / 2)
    s = graph.forecast_scores(rows, "ndvi", "predicted")
    return s.select("n", *(F.round(c, 6).alias(c) for c in ("rmse", "r2", "persistence_r2", "skill")))


@query("""WITH d AS (SELECT node, greatest(value - 2.4, 0) AS d FROM v_nodes), p AS (SELECT quantile_cont(d, 0.95) AS p FROM d WHERE d > 0) SELECT node, round(coalesce(least(d / p, 1.0), 0), 6) AS risk FROM d, p""")
def risk_index(spark, view):
    out = graph.risk_index(view("v_nodes").withColumn("after", F.lit(2.4)), "value", "after")
    return out.select("node", F.round("risk", 6).alias("risk"))


# Attributions given as a table: phi from embeddings.

_PHI = "SELECT vec_id, label AS class, unnest(['ndvi_gs_mean', 'clim_CDD', 'spei03_annual_mean', 'graz_total', 'popdens', 'elevation', 'road_distance_km', 'nbr3_class4_frac', 'from_class', 'aspect_sin']) AS feature, unnest(embedding[1:10]) AS phi FROM embeddings"
_NAMES = ("ndvi_gs_mean", "clim_CDD", "spei03_annual_mean", "graz_total", "popdens", "elevation", "road_distance_km", "nbr3_class4_frac", "from_class", "aspect_sin")


def _phi(view):
    pairs = F.array(*(F.struct(F.lit(n).alias("feature"), F.col("embedding")[i].cast("double").alias("phi")) for i, n in enumerate(_NAMES)))
    return view("embeddings").select("vec_id", F.col("label").alias("class"), F.inline(pairs))


@query(f"WITH p AS ({_PHI}), m AS (SELECT feature, class, avg(abs(CAST(phi AS DOUBLE))) AS mean_abs FROM p GROUP BY 1, 2) SELECT feature, class, round(mean_abs, 8) AS mean_abs, round(avg(mean_abs) OVER (PARTITION BY feature), 8) AS overall FROM m")
def shap_summary(spark, view):
    return models.attribution_summary(_phi(view)).select("feature", "class", F.round("mean_abs", 8).alias("mean_abs"), F.round("overall", 8).alias("overall"))


@query(f"""WITH p AS ({_PHI}), o AS (SELECT feature, round(avg(abs(CAST(phi AS DOUBLE))), 2) AS overall FROM p GROUP BY 1)
SELECT feature, overall, CAST(floor(rank() OVER (ORDER BY overall DESC) + (count(*) OVER (PARTITION BY overall) - 1) / 2.0) AS INT) AS "rank",
CASE WHEN feature LIKE 'ndvi%' THEN 'Vegetation productivity' WHEN feature LIKE 'spei%' THEN 'Drought (SPEI)' WHEN feature LIKE 'clim%' THEN 'Climate extremes' WHEN feature LIKE 'graz%' THEN 'Livestock/grazing' WHEN feature = 'popdens' THEN 'Population' WHEN feature = 'elevation' THEN 'Terrain'
WHEN feature LIKE 'road%' THEN 'Infrastructure' WHEN feature LIKE 'from%' THEN 'Prior class (autocorr.)' WHEN feature LIKE 'nbr%' THEN 'Neighbour class (autocorr.)' ELSE 'Other' END AS "group", feature LIKE 'from%' OR feature LIKE 'nbr%' AS autocorrelated FROM o""")
def shap_rank_groups(spark, view):
    o = _phi(view).groupBy("feature").agg(F.round(F.avg(F.abs("phi")), 2).alias("overall"))
    return models.average_rank(o, "overall").select("feature", "overall", "rank", feature_group(F.col("feature")).alias("group"), is_autocorrelated(F.col("feature")).alias("autocorrelated"))


@query("""WITH m AS (SELECT l_suppkey AS pixel, CAST(year(l_shipdate) AS INT) AS year, CAST(sum(CAST(l_extendedprice AS DECIMAL(14,2))) AS DOUBLE) / count(*) AS e, CAST(sum(CAST(l_quantity AS DECIMAL(8,2))) AS DOUBLE) / count(*) AS c FROM lineitem GROUP BY 1, 2),
em AS (SELECT * FROM (SELECT *, lag(e) OVER (PARTITION BY pixel ORDER BY year) AS e1, count(*) OVER (PARTITION BY pixel) AS n FROM m) WHERE e1 IS NOT NULL AND n >= 5),
d AS (SELECT a.pixel, a.year AS t, a.c AS y, b.year AS tl, b.c AS yl, sqrt((a.e - b.e) * (a.e - b.e) + (a.e1 - b.e1) * (a.e1 - b.e1)) AS d FROM em a JOIN em b ON a.pixel = b.pixel AND a.year <> b.year),
k AS (SELECT *, row_number() OVER (PARTITION BY pixel, t ORDER BY d, tl) AS rn, min(d) OVER (PARTITION BY pixel, t) AS md FROM d),
s AS (SELECT pixel, t, any_value(y) AS y, sum(exp(-d / greatest(md, 1e-12)) * yl) / sum(exp(-d / greatest(md, 1e-12))) AS est FROM k WHERE rn <= 3 GROUP BY 1, 2)
SELECT p.pixel AS pixel, round(corr(y, est), 6) AS rho FROM (SELECT DISTINCT pixel FROM m) p LEFT JOIN s ON s.pixel = p.pixel GROUP BY 1""")
def ccm_per_pixel(spark, view):
    mean = lambda c, kind: F.sum(F.col(c).cast(kind)).cast("double") / F.count("*")
    m = view("lineitem").groupBy(F.col("l_suppkey").alias("pixel"), F.year("l_shipdate").alias("year")).agg(mean("l_extendedprice", "decimal(14,2)").alias("e"), mean("l_quantity", "decimal(8,2)").alias("c"))
    return causal.per_pixel_ccm(m, "pixel", "e", "c").withColumn("rho", F.round("rho", 6))


@query("SELECT zone, t, round((ndvi - avg(ndvi) OVER (PARTITION BY zone)) / (stddev_pop(ndvi) OVER (PARTITION BY zone) + 1e-9), 6) AS z FROM v_series")
def standardised_series(spark, view):
    return features.standardise(view("v_series"), "ndvi", "zone").select("zone", "t", F.round("z", 6).alias("z"))


@query("SELECT zone, t, round(ndvi - lag(ndvi) OVER (PARTITION BY zone ORDER BY t), 6) AS change FROM v_series")
def first_difference(spark, view):
    return graph.persistence(view("v_series"), "zone", "t", "ndvi").select("zone", "t", F.round("change", 6).alias("change"))


@query("SELECT entity, year, round(coalesce(value, avg(value) OVER (PARTITION BY entity), 0), 7) AS value FROM v_annual")
def series_filled(spark, view):
    return features.fill_series(view("v_annual"), "entity", "value").select("entity", "year", F.round("value", 7).alias("value"))


@query("""SELECT entity, year, round(value, 7) AS value FROM (SELECT entity, year, value, count(*) OVER (PARTITION BY entity) AS n FROM v_annual WHERE value IS NOT NULL) WHERE n >= 7""")
def series_aligned(spark, view):
    """Series with enough years where all is given."""
    return causal.aligned(view("v_annual"), ["entity"], ["value"], 7).select("entity", "year", F.round("value", 7).alias("value"))


def _regional_sql() -> str:
    parts = []
    for driver in _DRIVERS:
        base = _SIMPLEX.replace("a.price", f"a.{driver}").replace("b.price", f"b.{driver}")
        full = f"WITH {base} SELECT zone, corr(observed, estimate) AS rho FROM s GROUP BY 1"
        # The small library: the five points of least hash.
        few = base.replace("FROM e a JOIN e b ON a.zone = b.zone", "FROM e a JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY (t * 7919 + 104729) % 1000003, t) AS _k FROM e) WHERE _k <= 5) b ON a.zone = b.zone")
        least = f"WITH {few} SELECT zone, corr(observed, estimate) AS rho FROM s GROUP BY 1"
        parts.append(f"SELECT '{driver}' AS driver, y.zone AS zone, y.n AS n_years, f.rho AS hi, l.rho AS lo FROM (SELECT zone, count(*) AS n FROM v_series GROUP BY 1) y LEFT JOIN ({full}) f ON f.zone = y.zone LEFT JOIN ({least}) l ON l.zone = y.zone")
    return f"""SELECT r.zone AS zone, driver, n_years, 3 AS dims, round(hi, 6) AS rho_max_lib, round(lo, 6) AS rho_min_lib, round(hi - lo, 6) AS convergence, coalesce(hi > 0.3 AND hi - lo > 0.05, false) AS causal
FROM ({' UNION ALL '.join(parts)}) r JOIN (SELECT c_mktsegment AS zone, count(*) AS n FROM customer GROUP BY 1) p ON p.zone = r.zone AND p.n >= 295"""


@query(_regional_sql())
def regional_screen(spark, view):
    """Every zone of enough pixels with every driver: skill of the whole and of a small library, and the verdict."""
    pixels = view("customer").groupBy(F.col("c_mktsegment").alias("zone")).agg(F.count("*").alias("n"))
    out = causal.regional_screen(view("v_series"), pixels, "ndvi", _DRIVERS, least_pixels=295)
    return out.select("zone", "driver", "n_years", "dims", *(F.round(c, 6).alias(c) for c in ("rho_max_lib", "rho_min_lib", "convergence")), "causal")


def _moments_sql(driver: str, k: int) -> str:
    """Squared errors of lag k: centred sums of products, and one elimination after the other."""
    names = [*(f"y{j}" for j in range(1, k + 1)), *(f"x{j}" for j in range(1, k + 1)), "y"]
    lags = ", ".join(f"lag(ndvi, {j}) OVER w AS y{j}, lag({driver}, {j}) OVER w AS x{j}" for j in range(1, k + 1))
    cells = ", ".join(f"covar_pop({a}, {b}) * count(*) AS m0_{i}_{j}" for i, a in enumerate(names) for j, b in enumerate(names) if j >= i)
    text = f"(SELECT zone, count(*) AS n, {cells} FROM (SELECT zone, ndvi AS y, {lags} FROM v_series WINDOW w AS (PARTITION BY zone ORDER BY t)) WHERE y{k} IS NOT NULL GROUP BY zone)"
    for p in range(2 * k):
        left = ", ".join(f"m{p}_{i}_{j} - m{p}_{p}_{i} * m{p}_{p}_{j} / m{p}_{p}_{p} AS m{p + 1}_{i}_{j}" for i in range(p + 1, 2 * k + 1) for j in range(i, 2 * k + 1))
        own = f", m{p}_{2 * k}_{2 * k} AS own" if p == k else ", own" if p > k else ""
        text = f"(SELECT zone, n, {left}{own} FROM {text})"
    return f"SELECT zone, '{driver}' AS driver, {k} AS lag, n, n - 1 - 2 * {k} AS free, greatest(0, (own - m{2 * k}_{2 * k}_{2 * k}) / {k} / (m{2 * k}_{2 * k}_{2 * k} / (n - 1 - 2 * {k}))) AS f FROM {text}"


# The tail of F as an integral: with x = sin^2 the incomplete beta function is smooth, and Simpson's rule over 2,000 steps is exact enough.
_LAGS_SQL = f"""l AS ({' UNION ALL '.join(_moments_sql(d, k) for d in _DRIVERS for k in (1, 2, 3))}),
i AS (SELECT zone, driver, lag, sum(w * pow(sin(top * s / 2000), free - 1) * pow(cos(top * s / 2000), lag - 1)) * top / 2000 / 3 AS part
      FROM (SELECT *, asin(sqrt(free / (free + lag * f))) AS top FROM l) CROSS JOIN (SELECT s, CASE WHEN s IN (0, 2000) THEN 1 WHEN s % 2 = 1 THEN 4 ELSE 2 END AS w FROM range(2001) g(s)) GROUP BY zone, driver, lag, top),
g AS (SELECT l.*, 2 * part * exp(lgamma((free + lag) / 2.0) - lgamma(free / 2.0) - lgamma(lag / 2.0)) AS p FROM l JOIN i USING (zone, driver, lag))"""


def _granger_lags(view):
    return causal.granger_lags(causal._long(view("v_series"), "ndvi", _DRIVERS, ["zone"], "t"), ["zone", "driver"])


@query(f"WITH {_LAGS_SQL} SELECT zone, driver, CAST(lag AS INT) AS lag, n, round(f, 6) AS f_stat, round(p, 8) AS p_value FROM g")
def granger_lags(spark, view):
    """F tests of lags 1 to 3, from moments of one aggregation."""
    return _granger_lags(view).select("zone", "driver", "lag", "n", F.round("f_stat", 6).alias("f_stat"), F.round("p_value", 8).alias("p_value"))


@query(f"WITH {_LAGS_SQL} SELECT zone, driver, CAST(lag AS INT) AS best_lag, round(p, 8) AS p_value FROM g QUALIFY row_number() OVER (PARTITION BY zone, driver ORDER BY p, lag) = 1")
def granger_best_lag(spark, view):
    """The lag of least p."""
    best = _granger_lags(view).groupBy("zone", "driver").agg(F.min(F.struct("p_value", "lag")).alias("b"))
    return best.select("zone", "driver", F.col("b.lag").alias("best_lag"), F.round("b.p_value", 8).alias("p_value"))


_LIBRARIES = f"""{_EMBED}, c AS (SELECT *, count(*) OVER (PARTITION BY zone) AS n FROM e),
z AS (SELECT DISTINCT zone, n, least(n, greatest(5, CASE q WHEN 0 THEN 5 WHEN 4 THEN n ELSE n * q // 4 END)) AS size FROM c CROSS JOIN range(5) g(q)),
b AS (SELECT zone, n, size, boot FROM z CROSS JOIN range(1, 9) g(boot) WHERE size < n OR boot = 1),
lib AS (SELECT * FROM (SELECT b.zone, b.size, b.boot, c.t, c.price, c.x0, c.x1, c.x2, row_number() OVER (PARTITION BY b.zone, b.size, b.boot ORDER BY ((c.t + 1) * (7919 + 2 * (b.size * 1000 + b.boot))) % 1000003, c.t) AS k FROM b JOIN c ON c.zone = b.zone) WHERE k <= size),
d AS (SELECT a.zone, lib.size, lib.boot, a.t, a.price AS y, lib.price AS yl, lib.t AS tl, sqrt((a.x0 - lib.x0) * (a.x0 - lib.x0) + (a.x1 - lib.x1) * (a.x1 - lib.x1) + (a.x2 - lib.x2) * (a.x2 - lib.x2)) AS d FROM c a JOIN lib ON lib.zone = a.zone AND lib.t <> a.t),
k AS (SELECT *, min(d) OVER (PARTITION BY zone, size, boot, t) AS m FROM d QUALIFY row_number() OVER (PARTITION BY zone, size, boot, t ORDER BY d, tl) <= 4),
s AS (SELECT zone, size, boot, t, any_value(y) AS observed, sum(exp(-d / greatest(m, 1e-12)) * yl) / sum(exp(-d / greatest(m, 1e-12))) AS estimate FROM k GROUP BY ALL HAVING count(*) = 4),
r AS (SELECT zone, size, boot, corr(observed, estimate) AS rho FROM s GROUP BY ALL)"""


@query(f"WITH {_LIBRARIES} SELECT zone, CAST(size AS INT) AS size, round(avg(rho), 6) AS rho, count(rho) AS n_boot FROM r GROUP BY zone, size")
def ccm_library_sizes(spark, view):
    """Skill with libraries of five sizes, eight draws each, from one pass over the distances."""
    return causal.ccm_libraries(view("v_series"), "price", "ndvi", ["zone"], 8).select("zone", "size", F.round("rho", 6).alias("rho"), "n_boot")


@query(f"WITH {_LIBRARIES}, a AS (SELECT zone, size, avg(rho) AS rho FROM r GROUP BY ALL) SELECT zone, round(max_by(rho, size) - min_by(rho, size), 6) AS convergence, round(max_by(rho, size), 6) AS rho_max_lib, round(min_by(rho, size), 6) AS rho_min_lib FROM a GROUP BY zone")
def ccm_convergence(spark, view):
    by = causal.ccm_libraries(view("v_series"), "price", "ndvi", ["zone"], 8)
    return causal.convergence(by, ["zone"]).select("zone", *(F.round(c, 6).alias(c) for c in ("convergence", "rho_max_lib", "rho_min_lib")))


# Random or iterative: rows only.


@query()
def regional_links(spark, view):
    """The regional run from series to links: Granger, cross mapping, surrogates, false discoveries, consensus."""
    return causal.regional_links(view("v_series"), "ndvi", _DRIVERS, ["zone"])


@query()
def ccm_bootstrap(spark, view):
    by = causal.ccm_bootstrap(view("v_series"), "price", "ndvi", ["zone"], (10, 30, 60), 30)
    return by.join(causal.convergence(by, ["zone"]).select("zone", "convergence"), "zone")


@query()
def ccm_surrogate_p(spark, view):
    return causal.surrogate_p(view("v_series"), "ndvi", _DRIVERS, ["zone"])


@query()
def granger_full(spark, view):
    return causal.granger_full(view("v_series"), "ndvi", _DRIVERS, ["zone"])


def _training(spark, view, nearby=True, around=False):
    """Transitions with their folds, stored: every pass of a model reads them again. Without ``nearby`` the classes of 2020 are left out;
    ``around`` adds the shares of all classes in the 3 x 3 cells around a cell, in the year that its transition starts from."""
    t = view("v_pairs").where("from_class > 0 AND to_class > 0").select("pix", "from_year", "from_class", "to_class", "conf_from")
    rows = t.join(evaluate.spatial_folds(view("v_grid")), "pix").withColumn("label", F.col("to_class") - 1)
    if nearby:
        rows = rows.join(view("v_class2020").select("pix", F.coalesce(F.col("class"), F.lit(0)).alias("nbr3_class")), "pix", "left")
    if around:
        cells = view("v_map").where("year < 2020").join(view("v_grid").select("pix", "r", "c"), "pix").select(F.col("year").alias("from_year"), "r", "c", "class")
        shares = grid.class_shares(cells, int(view("v_grid").agg(F.max("r")).first()[0]) + 1, _WIDTH, _CLASSES, keys=("from_year",))
        rows = rows.join(shares, ["from_year", "r", "c"], "left")  # a cell with a class sees itself, so none is lacking
    return catalog.stored(rows, "training")


_ROW = ["pix", "from_year"]
#: The folds that :func:`evaluate.spatial_folds` deals; each is left out once.
_FOLDS = 5
#: Columns of the grid, and classes but no data.
_WIDTH, _CLASSES = 125, 14
_AROUND = [f"nbr3_class{k}_frac" for k in range(1, _CLASSES + 1)]


@query()
def rf_spatial_cv(spark, view):
    return forests.spatial_cv(_training(spark, view, nearby=False), ["from_class", "conf_from", "x", "y"], "label", 14, trees=5, depth=4, key=_ROW)


@query()
def rf_importance(spark, view):
    """Shares of impurity gained by each feature, over the folds' forests."""
    names = ["from_class", "conf_from", "x", "y"]
    packs = forests.packed(_training(spark, view, nearby=False), names, "label", 14, fold="fold", trees=5, key=_ROW)
    return spark.createDataFrame(forests.fit(packs, held_out=range(_FOLDS), depth=4).importance(), "feature string, importance double")


_BOOSTED = boosting.Settings(rounds=8, depth=4, rate=0.3, patience=3)
_FEATURES = ["from_class", "conf_from", "nbr3_class", "x", "y"]


def _boosted(spark, view, features=_FEATURES):
    data = _training(spark, view).withColumn("row", F.col("pix") * 10000 + F.col("from_year"))
    return data, boosting.fit(data, features, "to_class", "row", fold="fold", held_out=range(5), bins=16, settings=_BOOSTED)


@query()
def boosted_spatial_cv(spark, view):
    """Scores of each spatial fold by one multiclass boosted model a fold, all fitted in the same passes."""
    data, model = _boosted(spark, view)
    return evaluate.classification_scores(model.predicted(data, "fold"), "to_class", "predicted", 15, "fold")


@query()
def boosted_importance(spark, view):
    """Share of gain and cover of each feature, over the folds' boosted models."""
    _, model = _boosted(spark, view)
    return spark.createDataFrame(model.importance(), "feature string, gain double, cover double")


@query()
def boosted_permutation(spark, view):
    """What accuracy each fold's boosted model loses where a column of the fold is permuted; all variants scored in one pass."""
    data, model = _boosted(spark, view)
    return evaluate.permutation_importance(data, "row", _FEATURES, "to_class", lambda d: model.predicted(d, "fold"), "fold")


@query()
def boosted_map(spark, view):
    """The class that one boosted model of all transitions expects five years after 2020, and its probability, for every cell."""
    data = _training(spark, view).withColumn("row", F.col("pix") * 10000 + F.col("from_year"))
    model = boosting.fit(data, _FEATURES, "to_class", "row", bins=16, settings=_BOOSTED)
    now = view("v_class2020").select("pix", F.col("class").alias("from_class"), F.col("class").alias("nbr3_class"), "x", "y")
    now = now.join(view("v_map").where("year = 2020").select("pix", F.col("conf").alias("conf_from")), "pix")
    return model.predicted(now).select("pix", "from_class", "predicted", F.round("predicted_p", 6).alias("probability"))


@query()
def ablation_without_neighbours(spark, view):
    """Scores over all folds with and without the shares of classes around a cell."""
    data = _training(spark, view, nearby=False, around=True)
    return forests.ablation(data, ["from_class", "conf_from", *_AROUND], ["nbr3_"], "label", 14, _FOLDS, trees=5, depth=4, key=_ROW)


@query()
def tree_shap(spark, view):
    data = _training(spark, view, nearby=False)
    names = ["from_class", "conf_from", "x"]
    model = forests.fit(forests.packed(data, names, "label", 14, trees=3, key=_ROW), depth=3).exported()
    sample = evaluate.stratified_sample(data.withColumn("row", F.col("pix") * 10000 + F.col("from_year")), "label", "row", 5)
    return models.attribution_summary(models.attributions(sample, model, names, "row"))


@query()
def spillover_gap(spark, view):
    nodes, edges = _graph(view)
    rows = catalog.stored(graph.neighbour_mean(nodes.withColumn("lagged", F.col("value") * 0.5 + (F.col("br") % 3) / 10.0), edges, ["lagged"]), "neighbours")  # read for two fits and two scores
    return models.spillover(rows.where("node % 5 > 0"), rows.where("node % 5 = 0"), ["lagged"], ["nbr_lagged"], "value")


_PANEL = "SELECT node, t, value * (1.0::DOUBLE + (node * 7 + t * 13) % 11 / 20.0::DOUBLE) AS value FROM v_nodes CROSS JOIN range(10) g(t)"


def _panel(spark, view):
    t = spark.range(10).select(F.col("id").alias("t"))
    return view("v_nodes").crossJoin(F.broadcast(t)).select("node", "t", (F.col("value") * (F.lit(1.0) + (F.col("node") * 7 + F.col("t") * 13) % 11 / F.lit(20.0))).alias("value"))


@query(f"""WITH p AS ({_PANEL}), z AS (SELECT node, t, value, (value - avg(value) OVER ()) / (stddev_pop(value) OVER () + 1e-9) AS z FROM p)
SELECT node, t, round(value, 11) AS value, round(a, 6) AS value_3, round(b, 6) AS value_2, round(c, 6) AS value_1 FROM (SELECT node, t, value, lag(z, 3) OVER w AS a, lag(z, 2) OVER w AS b, lag(z, 1) OVER w AS c FROM z WINDOW w AS (PARTITION BY node ORDER BY t)) WHERE a IS NOT NULL""")
def node_windows(spark, view):
    """Standardised values of the three steps before each one: what the networks see."""
    out = networks.windows(_panel(spark, view), "node", "t", ["value"], "value", 3)
    return out.select("node", "t", F.round("value", 11).alias("value"), *(F.round(c, 6).alias(c) for c in ("value_3", "value_2", "value_1")))


@query(f"""WITH {_ADJ}, p AS ({_PANEL}) SELECT p.node AS node, p.t AS t, round(p.value, 11) AS value, round(m.s, 9) AS nbr_value FROM p JOIN (SELECT ad.src, q.t, sum(w * q.value) AS s FROM ad JOIN p q ON q.node = ad.dst GROUP BY 1, 2) m ON m.src = p.node AND m.t = p.t""")
def panel_propagated(spark, view):
    nodes, edges = _graph(view)
    out = networks.with_propagated(graph.normalised_adjacency(nodes, edges), _panel(spark, view), ["value"])
    return out.select("node", "t", F.round("value", 11).alias("value"), F.round("nbr_value", 9).alias("nbr_value"))


@query()
def graph_models(spark, view):
    """Dense, recurrent and attentive networks without and with neighbours."""
    nodes, edges = _graph(view)
    return networks.compared(_panel(spark, view), graph.normalised_adjacency(nodes, edges), ["value"], "value", 8, rounds=40)


@query()
def spillover_recurrent(spark, view):
    """One recurrent network without and with the neighbours' means, on the change from step to step."""
    _, edges = _graph(view)
    return networks.spillover_test(_panel(spark, view), edges, ["value"], "value", 8, rounds=40)

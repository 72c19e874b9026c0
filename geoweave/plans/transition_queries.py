"""Queries of transitions, accuracy, baselines, folds and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoweave.functions import dims
from geoweave.operators import evaluate, manifest, transitions
from geoweave.plans.registry import query
from geoweave.sources import bucketed, catalog

_RANK = "CASE {0} " + " ".join(f"WHEN {c} THEN {r}" for c, r in dims.RANK.items()) + " END"


def _maps(view):
    return view("v_map").select("pix", "year", "class", "conf")


def _pairs(view):
    return transitions.pairs(_maps(view))


def _counts(view):
    return transitions.count_pairs(transitions.valid(_pairs(view)), "from_year")


@query("""SELECT CAST(from_year AS VARCHAR) || '-' || CAST(to_year AS VARCHAR) AS interval, count(*) AS n_valid_both, count(*) FILTER (from_class <> to_class) AS n_changed,
round_even(100.0::DOUBLE * count(*) FILTER (from_class <> to_class) / count(*), 2) AS change_rate_pct FROM v_pairs WHERE from_class > 0 AND to_class > 0 GROUP BY from_year, to_year""")
def change_rate_per_interval(spark, view):
    return transitions.change_rates(_pairs(view))


_MATRIX = """m AS (SELECT from_class, to_class, sum(n) AS n FROM v_transitions GROUP BY 1, 2), d AS (SELECT DISTINCT from_class AS class FROM m UNION SELECT to_class FROM m),
f AS (SELECT a.class AS from_class, b.class AS to_class, CAST(coalesce(n, 0) AS BIGINT) AS n FROM d a CROSS JOIN d b LEFT JOIN m ON m.from_class = a.class AND m.to_class = b.class)"""


@query(f"WITH {_MATRIX} SELECT from_class, to_class, n, CAST(sum(n) OVER (PARTITION BY from_class) AS BIGINT) AS total_from FROM f")
def transition_matrix(spark, view):
    return transitions.matrix(_counts(view), view("v_legend"))


@query(f"WITH {_MATRIX} SELECT from_class, to_class, CASE WHEN sum(n) OVER (PARTITION BY from_class) > 0 THEN round_even(100.0::DOUBLE * n / sum(n) OVER (PARTITION BY from_class), 2) END AS pct FROM f")
def transition_matrix_pct(spark, view):
    return transitions.matrix_percent(transitions.matrix(_counts(view), view("v_legend")))


@query("""WITH h AS (SELECT * FROM v_pairs WHERE from_class > 0 AND to_class > 0 AND conf_from >= 80 AND conf_to >= 80), rare AS (SELECT to_class AS class FROM h GROUP BY 1 HAVING count(*) < 400 UNION SELECT from_class FROM h GROUP BY 1 HAVING count(*) < 400)
SELECT from_year, to_year, from_class, to_class AS target_class, count(*) AS n FROM h WHERE from_class NOT IN (SELECT class FROM rare) AND to_class NOT IN (SELECT class FROM rare) GROUP BY 1, 2, 3, 4""")
def transition_pairs_highconf(spark, view):
    kept = transitions.without_rare(transitions.confident(transitions.valid(_pairs(view))), 400)
    return transitions.count_pairs(kept, "from_year", "to_year").withColumnRenamed("to_class", "target_class")


@query("SELECT to_class, count(*) AS n FROM v_pairs WHERE from_class > 0 AND to_class > 0 GROUP BY 1 HAVING count(*) >= 3000")
def transition_rare_target(spark, view):
    return transitions.without_rare(transitions.valid(_pairs(view)), 3000, both_ends=False).groupBy("to_class").agg(F.count("*").alias("n"))


@query("""SELECT from_class, to_class, total, pct FROM (SELECT from_class, to_class, CAST(sum(n) AS BIGINT) AS total, round_even(100.0::DOUBLE * sum(n) / sum(sum(n)) OVER (), 4) AS pct FROM v_transitions GROUP BY 1, 2)
WHERE from_class <> to_class AND total >= 100 AND pct >= 0.05""")
def transition_candidates(spark, view):
    return transitions.candidates(_counts(view), 100, 0.05)


@query("""SELECT from_class, to_class, total, top_window, share, share > 60 AS concentrated FROM (SELECT from_class, to_class, CAST(sum(n) AS BIGINT) AS total, arg_max(from_year, n * 10000 - from_year) AS top_window, round_even(100.0::DOUBLE * max(n) / sum(n), 2) AS share
FROM v_transitions WHERE from_class <> to_class GROUP BY 1, 2)""")
def transition_concentration(spark, view):
    return transitions.concentration(_counts(view))


@query("SELECT from_year, CAST(sum(n) FILTER (from_class = to_class) AS BIGINT) AS stable, CAST(sum(n) FILTER (from_class <> to_class) AS BIGINT) AS changed FROM v_transitions GROUP BY 1")
def transition_stable_changed(spark, view):
    return transitions.stable_and_changed(_counts(view))


_A, _B = _RANK.format("from_class"), _RANK.format("to_class")
_GRADIENT = f"CASE WHEN {_B} < {_A} THEN 'recovery' WHEN {_B} > {_A} THEN 'degradation' ELSE 'agricultural' END"


@query(f"SELECT {_GRADIENT} AS direction, CAST(sum(n) AS BIGINT) AS n FROM v_transitions WHERE from_class <> to_class GROUP BY 1")
def transition_direction_gradient(spark, view):
    return transitions.directions(_counts(view), "gradient")


@query(f"""SELECT CASE WHEN {_B} < {_A} AND to_class IN (1, 3, 4, 5, 6) THEN 'recovery' WHEN {_B} < {_A} THEN 'arid reshuffle' WHEN {_B} > {_A} AND from_class IN (11, 12, 13) AND to_class IN (11, 12, 13) THEN 'arid reshuffle'
WHEN {_B} > {_A} THEN 'degradation' ELSE 'agricultural' END AS direction, CAST(sum(n) AS BIGINT) AS n FROM v_transitions WHERE from_class <> to_class GROUP BY 1""")
def transition_direction_strict(spark, view):
    return transitions.directions(_counts(view), "strict")


@query(f"SELECT CAST(r AS BIGINT) AS recovery, CAST(d AS BIGINT) AS degradation, round_even(CAST(r AS DOUBLE) / greatest(d, 1), 6) AS ratio FROM (SELECT sum(n) FILTER ({_B} < {_A}) AS r, sum(n) FILTER ({_B} > {_A}) AS d FROM v_transitions WHERE from_class <> to_class)")
def recovery_ratio(spark, view):
    return transitions.recovery_ratio(transitions.directions(_counts(view), "gradient"))


@query("""SELECT m.year AS year, CASE WHEN m.class > 0 AND p.class > 0 THEN CASE WHEN m.class <> p.class THEN 1 ELSE 0 END ELSE -1 END AS change_flag, count(*) AS n
FROM v_map m LEFT JOIN v_map p ON p.pix = m.pix AND p.year = m.year - 5 GROUP BY 1, 2""")
def previous_class_flag(spark, view):
    return transitions.previous_class(_maps(view)).withColumn("change_flag", F.coalesce("change_flag", F.lit(-1))).groupBy("year", "change_flag").agg(F.count("*").alias("n"))


@query("SELECT mapped, reference, count(*) AS n FROM v_points WHERE reference > 0 GROUP BY 1, 2")
def confusion_matrix(spark, view):
    return evaluate.confusion(evaluate.reference_points(view("v_points")))


_GROUP = "(3, 4, 5, 6)"


@query(f"""SELECT 'all' AS points, count(*) AS n, count(*) FILTER (mapped = reference) AS n_correct, round(CAST(count(*) FILTER (mapped = reference) AS DOUBLE) / count(*), 6) AS accuracy FROM v_points WHERE reference > 0
UNION ALL SELECT 'grassland', count(*), count(*) FILTER (mapped = reference), round(CAST(count(*) FILTER (mapped = reference) AS DOUBLE) / count(*), 6) FROM v_points WHERE reference > 0 AND (mapped IN {_GROUP} OR reference IN {_GROUP})""")
def confusion_accuracy(spark, view):
    m = evaluate.confusion(evaluate.reference_points(view("v_points")))
    parts = [evaluate.overall_accuracy(m, g).select(F.lit(name).alias("points"), "n", "n_correct", "accuracy") for name, g in (("all", None), ("grassland", (3, 4, 5, 6)))]
    return parts[0].unionAll(parts[1])


@query("""WITH p AS (SELECT * FROM v_points WHERE reference > 0), c AS (SELECT mapped AS class FROM p UNION SELECT reference FROM p)
SELECT class, CASE WHEN m > 0 THEN round(CAST(h AS DOUBLE) / m, 6) END AS user_accuracy, CASE WHEN r > 0 THEN round(CAST(h AS DOUBLE) / r, 6) END AS producer_accuracy
FROM (SELECT class, (SELECT count(*) FROM p WHERE mapped = class) AS m, (SELECT count(*) FROM p WHERE reference = class) AS r, (SELECT count(*) FROM p WHERE mapped = class AND reference = class) AS h FROM c)""")
def accuracy_by_class(spark, view):
    return evaluate.accuracy_by_class(evaluate.confusion(evaluate.reference_points(view("v_points"))))


_STRATA = """p AS (SELECT mapped, reference FROM v_points WHERE reference > 0), n AS (SELECT mapped, reference, count(*) AS n FROM p GROUP BY 1, 2), a AS (SELECT class, CAST(count(*) AS DOUBLE) AS area FROM v_map WHERE year = 2020 AND class > 0 GROUP BY 1),
s AS (SELECT n.mapped, reference, n, sum(n) OVER (PARTITION BY n.mapped) AS m, area / (SELECT sum(area) FROM a) AS w FROM n JOIN a ON a.class = n.mapped),
v AS (SELECT *, n / m AS q, CASE WHEN m > 1 THEN n / m * (1 - n / m) / (m - 1) ELSE 0 END AS sp FROM s)"""


def _area_points(view):
    """The confusion matrix of the reference points, and the map's area by class."""
    areas = view("v_map").where("year = 2020 AND class > 0").groupBy("class").agg(F.count("*").cast("double").alias("area"))
    return evaluate.confusion(evaluate.reference_points(view("v_points"))), areas


@query(f"""WITH {_STRATA}, o AS (SELECT mapped, max(m) AS m, max(w) AS w, coalesce(sum(n) FILTER (mapped = reference), 0) / max(m) AS u FROM s GROUP BY 1), t AS (SELECT sum(w * u) AS acc, sqrt(sum(w * w * CASE WHEN m > 1 THEN u * (1 - u) / (m - 1) ELSE 0 END)) AS se FROM o)
SELECT round(acc, 8) AS accuracy, round(se, 8) AS se, round(acc - 1.96 * se, 8) AS low, round(acc + 1.96 * se, 8) AS high FROM t""")
def accuracy_area_weighted(spark, view):
    """Overall accuracy by mapped area with its interval."""
    return evaluate.area_weighted_overall(*_area_points(view)).select(*(F.round(c, 8).alias(c) for c in ("accuracy", "se", "low", "high")))


@query(f"""WITH {_STRATA}, tot AS (SELECT sum(area) AS t FROM a), u AS (SELECT mapped AS class, coalesce(sum(q) FILTER (mapped = reference), 0) AS us, sqrt(coalesce(sum(sp) FILTER (mapped = reference), 0)) AS ue FROM v GROUP BY 1),
r AS (SELECT reference AS class, sum(w * q) AS share, sum(w * w * sp) AS var, coalesce(sum(w * q) FILTER (mapped = reference), 0) AS hit, coalesce(sum(w * w * sp) FILTER (mapped = reference), 0) AS ownv, coalesce(sum(w * w * sp) FILTER (mapped <> reference), 0) AS oth FROM v GROUP BY 1)
SELECT coalesce(r.class, u.class) AS class, round(share * t, 6) AS area, round(sqrt(var) * t, 6) AS area_se, round(us, 8) AS "user", round(ue, 8) AS user_se, round(hit / share, 8) AS producer,
round(sqrt(((1 - hit / share) * (1 - hit / share) * ownv + hit / share * hit / share * oth) / (share * share)), 8) AS producer_se FROM r FULL JOIN u ON u.class = r.class CROSS JOIN tot""")
def accuracy_area_by_class(spark, view):
    """Estimated areas, users' and producers' accuracies with their standard errors."""
    out = evaluate.area_weighted_accuracy(*_area_points(view))
    return out.select("class", *(F.round(c, 6).alias(c) for c in ("area", "area_se")), *(F.round(c, 8).alias(c) for c in ("user", "user_se", "producer", "producer_se")))


_SHUFFLED = "row_number() OVER (ORDER BY ({k} * {a} + {b}) % 1000003, {k}) - 1"


@query(f"""WITH b AS (SELECT o_orderkey AS id, CAST(o_custkey AS DOUBLE) AS u, CAST(o_totalprice AS DOUBLE) AS v, {_SHUFFLED.format(k='o_orderkey', a=7919, b=0)} AS k0, {_SHUFFLED.format(k='o_orderkey', a=7921, b=104729)} AS k1, {_SHUFFLED.format(k='o_orderkey', a=7923, b=209458)} AS k2 FROM orders)
SELECT id, NULL AS permuted, u, v FROM b UNION ALL SELECT x.id, 'u', y.u, x.v FROM b x JOIN b y ON y.k1 = x.k0 UNION ALL SELECT x.id, 'v', x.u, y.v FROM b x JOIN b y ON y.k2 = x.k0""")
def columns_permuted(spark, view):
    """Every order with one of two columns permuted, and as it is."""
    rows = view("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("u"), F.col("o_totalprice").alias("v"))
    return evaluate.permuted(rows, "id", ["u", "v"])


@query("SELECT from_year, to_year, from_class, to_class, count(*) AS n, CAST(sum(conf_from + conf_to) AS BIGINT) AS conf FROM v_pairs GROUP BY 1, 2, 3, 4")
def transition_pairs_bucketed(spark, view):
    """Pairs of years of a map that is stored in buckets of pixels: joined without an exchange."""
    name = bucketed.write(_maps(view), "pix", max(8, view("orders").count() // 50_000))  # a bucket is a task, so their number grows with the map
    return bucketed.year_pairs(spark, name).groupBy("from_year", "to_year", "from_class", "to_class").agg(F.count("*").alias("n"), F.sum(F.col("conf_from") + F.col("conf_to")).alias("conf"))


@query("""WITH k AS (SELECT product_id, year FROM v_unified GROUP BY 1, 2) SELECT 1 AS run, CAST(product_id AS VARCHAR) AS product, year FROM k UNION ALL SELECT 3, CAST(product_id AS VARCHAR), year FROM k WHERE product_id = 3""")
def manifest_runs(spark, view):
    """What three runs of a step make: everything at first, nothing when nothing changed, and one product's years when its rows changed."""
    inputs = catalog.stored(view("v_unified").select("pix", "year", F.col("product_id").alias("product"), "unified"), "inputs")  # three runs read it for digests, two for what they make
    changed = inputs.withColumn("unified", F.when((F.col("product") == 3) & (F.col("pix") % 7 == 0), F.lit(0)).otherwise(F.col("unified")))
    base, made = catalog.scratch(spark), []
    counts = lambda d: d.groupBy("product", "year", "unified").agg(F.count("*").alias("n"))
    for run, rows in enumerate((inputs, inputs, changed), 1):
        made += [(run, *x) for x in manifest.refresh(spark, f"{base}-manifest", "histogram", rows, counts, f"{base}-histogram", {"by": "class"})]
    return spark.createDataFrame(made, "run int, product string, year int")


# Folds: blocks of the 10 km grid, dealt by an integer hash.

_BLOCK = "CAST(floor(x / 100000) AS BIGINT) * 100000 + CAST(floor(y / 100000) AS BIGINT)"
_TRUNC = "CAST(trunc(x / 100000) AS BIGINT) * 100000 + CAST(trunc(y / 100000) AS BIGINT)"
_MOD = "((({0} * 7919 + 104729) % 1000003) + 1000003) % 1000003"


def _fold_ctes(block: str = _BLOCK) -> str:
    return f"""b AS (SELECT *, {block} AS block FROM v_grid), fo AS (SELECT block, CAST((row_number() OVER (ORDER BY {_MOD.format("block")}, block) - 1) % 5 AS INT) AS fold FROM (SELECT DISTINCT block FROM b))"""


@query(f"WITH {_fold_ctes()} SELECT b.block AS block, fold, count(*) AS n FROM b JOIN fo ON fo.block = b.block GROUP BY 1, 2")
def spatial_block_folds(spark, view):
    return evaluate.spatial_folds(view("v_grid")).groupBy("block", "fold").agg(F.count("*").alias("n"))


@query(f"WITH {_fold_ctes(_TRUNC)} SELECT b.block AS block, fold, count(*) AS n FROM b JOIN fo ON fo.block = b.block GROUP BY 1, 2")
def spatial_block_folds_truncated(spark, view):
    return evaluate.spatial_folds(view("v_grid"), truncate=True).groupBy("block", "fold").agg(F.count("*").alias("n"))


def _folded(view):
    return transitions.valid(_pairs(view)).join(evaluate.spatial_folds(view("v_grid")).select("pix", "fold"), "pix")


_PF = f"{_fold_ctes()}, pf AS (SELECT p.*, fold FROM v_pairs p JOIN b ON b.pix = p.pix JOIN fo ON fo.block = b.block WHERE from_class > 0 AND to_class > 0)"


def _scores(source: str) -> str:
    """SQL scores of rows (fold, y, p)."""
    return f"""cl AS (SELECT DISTINCT fold, y AS class FROM {source} UNION SELECT DISTINCT fold, p FROM {source}),
f1 AS (SELECT fold, class, (SELECT count(*) FROM {source} s WHERE s.fold = cl.fold AND y = class) AS su, (SELECT count(*) FROM {source} s WHERE s.fold = cl.fold AND p = class) AS ca, (SELECT count(*) FROM {source} s WHERE s.fold = cl.fold AND p = class AND y = class) AS h FROM cl),
sc AS (SELECT fold, round(sum(CASE WHEN su + ca > 0 THEN 2.0::DOUBLE * h / (su + ca) ELSE 0 END) / 14, 6) AS macro_f1, round(sum(CASE WHEN su + ca > 0 THEN 2.0::DOUBLE * h / (su + ca) ELSE 0 END * su) / sum(su), 6) AS weighted_f1 FROM f1 GROUP BY fold),
ac AS (SELECT fold, round(avg(CASE WHEN y = p THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy FROM {source} GROUP BY fold)"""


@query(f"WITH {_PF}, s AS (SELECT fold, to_class AS y, from_class AS p FROM pf), {_scores('s')} SELECT sc.fold AS fold, accuracy, macro_f1, weighted_f1 FROM sc JOIN ac ON ac.fold = sc.fold")
def baseline_persistence(spark, view):
    return evaluate.persistence_baseline(_folded(view), 14)


_MARKOV = """md AS (SELECT f.fold, from_class, to_class, count(*) AS n FROM (SELECT DISTINCT fold FROM pf) f JOIN pf ON pf.fold <> f.fold GROUP BY 1, 2, 3),
mo AS (SELECT fold, from_class, to_class FROM (SELECT *, row_number() OVER (PARTITION BY fold, from_class ORDER BY n DESC, to_class) AS rn FROM md) WHERE rn = 1),
s AS (SELECT pf.fold AS fold, pf.to_class AS y, coalesce(mo.to_class, pf.from_class) AS p FROM pf LEFT JOIN mo ON mo.fold = pf.fold AND mo.from_class = pf.from_class)"""


@query(f"WITH {_PF}, {_MARKOV}, {_scores('s')} SELECT sc.fold AS fold, accuracy, macro_f1, weighted_f1 FROM sc JOIN ac ON ac.fold = sc.fold")
def baseline_markov(spark, view):
    return evaluate.markov_baseline(_folded(view), 14)


@query(f"WITH {_PF}, s AS (SELECT fold, to_class AS y, from_class AS p FROM pf), {_scores('s')} SELECT round(avg(accuracy), 6) AS accuracy, round(avg(macro_f1), 6) AS macro_f1, round(avg(weighted_f1), 6) AS weighted_f1 FROM sc JOIN ac ON ac.fold = sc.fold")
def baseline_persistence_mean(spark, view):
    return evaluate.mean_of_folds(evaluate.persistence_baseline(_folded(view), 14))


@query("""WITH l AS (SELECT quality AS y, toxic AS p FROM labels), c AS (SELECT 0 AS class UNION SELECT 1),
f AS (SELECT class, (SELECT count(*) FROM l WHERE y = class) AS support, (SELECT count(*) FROM l WHERE p = class) AS called, (SELECT count(*) FROM l WHERE p = class AND y = class) AS h FROM c)
SELECT CAST(class AS INT) AS class, support, round(CASE WHEN support + called > 0 THEN 2.0::DOUBLE * h / (support + called) ELSE 0 END, 6) AS f1 FROM f""")
def macro_f1(spark, view):
    labels = view("labels").select(F.col("quality").cast("int").alias("y"), F.col("toxic").cast("int").alias("p"))
    return evaluate.f1_by_class(labels, "y", "p").select("class", "support", F.round("f1", 6).alias("f1"))


_DRAW = "(((42 * 31 + pix * 7919 + 12345) % 1000003) * 48271) % 1000003"


@query(f"SELECT class, pix FROM (SELECT class, pix, row_number() OVER (PARTITION BY class ORDER BY {_DRAW}, pix) AS rn FROM v_class2020 WHERE class > 0) WHERE rn <= 30")
def stratified_sample(spark, view):
    return evaluate.stratified_sample(view("v_class2020").where("class > 0").select("class", "pix"), "class", "pix", 30)


@query("""WITH c AS (SELECT from_class, to_class, count(*) AS n FROM v_pairs WHERE from_class > 0 AND to_class > 0 GROUP BY 1, 2)
SELECT from_class, to_class, n, least(n, CAST(round_even(round(ln(1 + n) / (SELECT sum(ln(1 + n)) FROM c) * 2000, 9), 0) AS BIGINT)) AS quota FROM c""")
def log_quota_sample(spark, view):
    return evaluate.log_quotas(transitions.valid(_pairs(view)), ["from_class", "to_class"], 2000)


@query("SELECT pix FROM (SELECT pix, row_number() OVER (ORDER BY r, c) - 1 AS k FROM v_class2020) WHERE k % 3 = 0")
def stride_sample(spark, view):
    return evaluate.stride_sample(view("v_class2020").select("pix", "r", "c"), 3).select("pix")


@query("SELECT year FROM v_unified WHERE product_id = 5 AND unified > 0 INTERSECT SELECT year FROM v_driver WHERE variable = 'popdens' AND value IS NOT NULL EXCEPT SELECT year FROM v_driver WHERE variable = 'glw'")
def shared_years(spark, view):
    """Set operations on what the tables hold: years that a product and a driver share, less those of another driver."""
    of = lambda v: view("v_driver").where(F.col("variable") == v)
    product = view("v_unified").where("product_id = 5 AND unified > 0").select("year")
    return product.intersect(of("popdens").where("value IS NOT NULL").select("year")).subtract(of("glw").select("year"))

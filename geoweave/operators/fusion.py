"""Two-tier Bayesian fusion of categorical votes.

Votes become one wide row for each pixel and year, by the only shuffle; everything after it
is arithmetic on columns inside generated code. A pixel without votes is still classified,
by the prior, with agreement 0.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoweave.functions import dims
from geoweave.functions.expressions import at_code, first_equal, to_l1, truncated_percent


def widen(votes: DataFrame, keys: Sequence[str] = ("pix", "year"), products: Sequence[int] = tuple(dims.PRODUCTS)) -> DataFrame:
    """(keys, v1..vP): the unified vote of each product, null where it has none."""
    wide = votes.groupBy(*keys).pivot("product_id", list(products)).agg(F.min("unified"))
    return wide.select(*keys, *(F.col(str(p)).alias(f"v{p}") for p in products))


def priors(votes: DataFrame, product: int = 1) -> DataFrame:
    """One row: l1_1..l1_9 and l2_<class>, Laplace-smoothed class shares of the product's votes."""
    v = votes.where(F.col("product_id") == product).withColumn("l1", to_l1(F.col("unified")))
    counts = [F.count_if(F.col("l1") == k).alias(f"l1_{k}") for k in dims.L1_CLASSES]
    counts += [F.count_if(F.col("unified") == m).alias(f"l2_{m}") for ms in dims.SUBCLASSES.values() for m in ms]
    row = v.agg(*counts)
    groups = [[f"l1_{k}" for k in dims.L1_CLASSES], *([f"l2_{m}" for m in ms] for ms in dims.SUBCLASSES.values())]
    return row.select(*(((F.col(c) + 1) / sum(F.col(d) + 1 for d in g)).alias(c) for g in groups for c in g))


#: (product, classes, whether in the second decision) to the logarithms of a right and of a wrong vote.
Logs = Callable[[int, int, bool], tuple[object, object]]


def constant_logs(delta: float = 0.0, floor: float = dims.SUB_ERROR_FLOOR) -> Logs:
    """Logarithms from the products' weights moved by ``delta``; the soft product errs at least ``floor`` in the second decision."""

    def logs(product: int, classes: int, second: bool) -> tuple[float, float]:
        e = dims.error_rate(dims.PRODUCTS[product][1], delta)
        e = max(floor, e) if second and product == dims.SOFT_PRODUCT else e
        return math.log(1 - e), math.log(e / (classes - 1))

    return logs


def _posterior(priors: Mapping[int, Column], votes: Sequence[tuple[int, Column]], logs: Logs, second: bool, name: str) -> list[Column]:
    """Log posteriors of the classes up to a constant; votes are (product, vote or 0).

    What a wrong vote costs is the same for all other classes, so a vote adds the difference
    between right and wrong to its own class only. Written as products of non-null values,
    which need less generated code than cases do."""
    out = []
    for cls, prior in priors.items():
        terms = []
        for p, vote in votes:
            right, wrong = logs(p, len(priors), second)
            terms.append((vote == cls).cast("double") * (right - wrong))
        out.append(reduce(lambda a, b: a + b, terms, prior).alias(f"{name}{cls}"))
    return out


def _best(df: DataFrame, name: str, classes: Sequence[int], label: str, share: str) -> DataFrame:
    """Adds the class of the greatest log posterior (ties to the first) and its posterior."""
    cols = [F.col(f"{name}{c}") for c in classes]
    df = df.withColumn(f"{name}max", F.greatest(*cols))
    top = F.col(f"{name}max")
    df = df.withColumns({label: first_equal(cols, top, classes), share: F.lit(1.0) / reduce(lambda a, b: a + b, (F.exp(c - top) for c in cols))})
    return df.drop(f"{name}max", *(f"{name}{c}" for c in classes))


def level1(rows: DataFrame, logs: Logs) -> DataFrame:
    """Adds map_l1, post_l1 and agreement to wide votes with priors. Specialists vote in their super-classes only."""
    counted = {}
    for p, (*_, spec) in dims.PRODUCTS.items():
        u = F.col(f"u{p}")
        counted[f"c{p}"] = (u == spec[0]).cast("int") * spec[0] if spec else u
    rows = rows.withColumns({f"u{p}": at_code(dims.UNIFIED_TO_L1, F.col(f"v{p}")) for p in dims.PRODUCTS}).withColumns(counted)
    rows = rows.select("*", *_posterior({k: F.col(f"l1_{k}") for k in dims.L1_CLASSES}, [(p, F.col(f"c{p}")) for p in dims.PRODUCTS], logs, False, "a"))
    rows = _best(rows, "a", dims.L1_CLASSES, "map_l1", "post_l1")
    agree = reduce(lambda a, b: a + b, ((F.col(f"u{p}") == F.col("map_l1")).cast("int") for p in dims.PRODUCTS))
    return rows.withColumn("agreement", agree).drop(*(f"{c}{p}" for c in "uc" for p in dims.PRODUCTS))


def level2(rows: DataFrame, logs: Logs) -> DataFrame:
    """Adds sub and post_l2: the second decision within grassland and bare, by the authorities; null and 1 elsewhere."""
    for group, members in dims.SUBCLASSES.items():
        votes = [(p, F.col(f"v{p}")) for p in dims.AUTHORITIES[group]]
        rows = rows.select("*", *_posterior({m: F.col(f"l2_{m}") for m in members}, votes, logs, True, f"b{group}_"))
        rows = _best(rows, f"b{group}_", members, f"sub{group}", f"share{group}")
    pick = lambda name, other: F.when(F.col("map_l1") == 3, F.col(f"{name}3")).when(F.col("map_l1") == 8, F.col(f"{name}8")).otherwise(F.lit(other))
    return rows.withColumns({"sub": pick("sub", None), "post_l2": pick("share", 1.0)}).drop("sub3", "sub8", "share3", "share8")


def assemble(rows: DataFrame) -> DataFrame:
    """Adds the fused class, the confidences in per cent and the decision entropy (100 less the joint confidence)."""
    return rows.withColumns(
        {
            "fused": F.coalesce(F.col("sub"), at_code(dims.L1_DIRECT, F.col("map_l1"))),
            "conf_joint": truncated_percent(F.col("post_l1") * F.col("post_l2")),
            "conf_l1": truncated_percent(F.col("post_l1")),
            "conf_l2": truncated_percent(F.col("post_l2")),
        }
    ).withColumn("decision_entropy", F.lit(100) - F.col("conf_joint"))


def with_priors(votes: DataFrame, cells: DataFrame, prior: DataFrame) -> DataFrame:
    """Wide votes of every cell beside the one row of logarithms of the priors: one shuffle of the votes and one join.
    Products without a vote have 0."""
    wide = cells.join(widen(votes), ["pix", "year"], "left").na.fill(0, [f"v{p}" for p in dims.PRODUCTS])
    logs = prior.select(*(F.coalesce(F.ln(F.col(c) + 1e-12), F.lit(math.log(1e-12))).alias(c) for c in prior.columns))
    return wide.crossJoin(F.broadcast(logs))


def fuse(votes: DataFrame, cells: DataFrame, prior: DataFrame, delta: float = 0.0, floor: float = dims.SUB_ERROR_FLOOR) -> DataFrame:
    """The fused map of every cell (pix, year)."""
    logs = constant_logs(delta, floor)
    rows = assemble(level2(level1(with_priors(votes, cells, prior), logs), logs))
    return rows.select("pix", "year", "fused", "conf_joint", "conf_l1", "conf_l2", "decision_entropy", "agreement", "map_l1", "sub", "post_l1", "post_l2")


def subclasses(fused: DataFrame) -> DataFrame:
    """(pix, year, sub, conf_l2) of the cells with a second decision.

    A generator drops the others: a filter would be pushed below the posteriors and evaluate them twice."""
    some = F.array(F.struct("sub", "conf_l2"))
    return fused.select("pix", "year", F.inline(F.when(F.col("sub").isNotNull(), some)))


def shannon_entropy(rows: DataFrame, prefix: str, classes: Sequence[int]) -> Column:
    """True Shannon entropy in bits of posterior columns ``prefix<class>`` (an extension)."""
    p = [F.col(f"{prefix}{c}") for c in classes]
    return -reduce(lambda a, b: a + b, (F.when(x > 0, x * F.log2(x)).otherwise(0.0) for x in p))


def class_area(fused: DataFrame) -> DataFrame:
    """(year, class, n, area_pct, mean_conf, mean_agreement): a pixel is one unit of area."""
    by = fused.groupBy("year", F.col("fused").alias("class")).agg(F.count("*").alias("n"), F.sum("conf_joint").alias("c"), F.sum("agreement").alias("a"))
    held = by.withColumn("total", F.sum("n").over(Window.partitionBy("year")))  # a join with the totals would fuse every cell twice
    return held.select(
        "year", "class", "n", F.round(F.lit(100.0) * F.col("n") / F.col("total"), 3).alias("area_pct"), F.round(F.col("c") / F.col("n"), 6).alias("mean_conf"), F.round(F.col("a") / F.col("n"), 6).alias("mean_agreement")
    )


def sensitivity(votes: DataFrame, cells: DataFrame, prior: DataFrame, floors: Sequence[float] = (0.3, 0.4, 0.5), deltas: Sequence[float] = (-0.1, 0.0, 0.1), base: tuple[float, float] = (0.4, 0.0)) -> DataFrame:
    """(setting, max_dev, mean_dev, steppe_dev, bare_dev): how class shares move against the base setting.

    Settings are a short array of logarithms that every row is exploded by, so one job with one
    set of expressions covers them all; what follows handles a row for each setting and class."""
    entries = []
    for floor in floors:
        for delta in deltas:
            logs = constant_logs(delta, floor)
            fields = [F.lit(f"eps{floor}_dw{delta:+.2f}").alias("setting")]
            for second, classes in ((False, (len(dims.L1_CLASSES),)), (True, tuple(map(len, dims.SUBCLASSES.values())))):
                for k in classes:
                    for p in dims.PRODUCTS:
                        right, wrong = logs(p, k, second)
                        fields += [F.lit(right).alias(f"right{p}_{k}"), F.lit(wrong).alias(f"wrong{p}_{k}")]
            entries.append(F.struct(*fields))
    rows = with_priors(votes, cells, prior).select("*", F.inline(F.array(*entries)))
    by_column: Logs = lambda p, k, second: (F.col(f"right{p}_{k}"), F.col(f"wrong{p}_{k}"))
    counts = assemble(level2(level1(rows, by_column), by_column)).groupBy("setting", F.col("fused").alias("class")).agg(F.count("*").alias("n"))
    name = f"eps{base[0]}_dw{base[1]:+.2f}"
    shares = counts.withColumn("pct", F.round(F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy("setting")), 6))
    at_base = F.max(F.when(F.col("setting") == name, F.col("pct"))).over(Window.partitionBy("class"))
    dev = shares.withColumn("dev", F.abs(F.col("pct") - at_base))
    return dev.groupBy("setting").agg(
        F.round(F.max("dev"), 3).alias("max_dev"), F.round(F.avg("dev"), 3).alias("mean_dev"),
        F.round(F.max(F.when(F.col("class").isin(3, 4, 5, 6), F.col("dev"))), 3).alias("steppe_dev"), F.round(F.max(F.when(F.col("class").isin(11, 12, 13), F.col("dev"))), 3).alias("bare_dev"),
    )

"""Class transitions between anchor years."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoweave.functions.expressions import direction_gradient, direction_strict


def pairs(maps: DataFrame, step: int = 5, keys: tuple[str, ...] = ("pix",), keep: tuple[str, ...] = ("class", "conf")) -> DataFrame:
    """Every cell's values at a year and ``step`` years later: (keys, from_year, to_year, from_<c>, to_<c>).

    A self equi-join on cell and year, so a cell missing at either end has no pair."""
    a = maps.select(*keys, F.col("year").alias("from_year"), (F.col("year") + step).alias("to_year"), *(F.col(c).alias(f"from_{c}") for c in keep))
    b = maps.select(*keys, F.col("year").alias("to_year"), *(F.col(c).alias(f"to_{c}") for c in keep))
    return a.join(b, [*keys, "to_year"])


def valid(df: DataFrame) -> DataFrame:
    return df.where("from_class > 0 AND to_class > 0")


def confident(df: DataFrame, least: int = 80) -> DataFrame:
    """Pairs that are confident at both ends."""
    return df.where((F.col("from_conf") >= least) & (F.col("to_conf") >= least))


def without_rare(df: DataFrame, least: int = 50, both_ends: bool = True) -> DataFrame:
    """Pairs whose classes have ``least`` rows or more as target and (``both_ends``) as source.

    Counts are aggregated to the few classes first and broadcast back: no window over all rows."""
    targets = df.groupBy("to_class").agg(F.count("*").alias("n")).where(F.col("n") < least).select(F.col("to_class").alias("class"))
    rare = targets.union(df.groupBy("from_class").agg(F.count("*").alias("n")).where(F.col("n") < least).select("from_class")).distinct() if both_ends else targets
    out = df.join(F.broadcast(rare), df.to_class == rare["class"], "left_anti")
    return out.join(F.broadcast(rare), out.from_class == rare["class"], "left_anti") if both_ends else out


def count_pairs(df: DataFrame, *more: str) -> DataFrame:
    return df.groupBy(*more, "from_class", "to_class").agg(F.count("*").alias("n"))


def matrix(counts: DataFrame, legend: DataFrame) -> DataFrame:
    """Counts for every pair of classes that occur at either end, 0 where there are none: (from_class, to_class, n, total_from)."""
    total = counts.groupBy("from_class", "to_class").agg(F.sum("n").alias("n"))
    seen = total.select(F.col("from_class").alias("class")).union(total.select("to_class")).distinct()
    domain = legend.select("class").join(F.broadcast(seen), "class", "left_semi")  # at most the legend
    cells = domain.select(F.col("class").alias("from_class")).crossJoin(F.broadcast(domain.select(F.col("class").alias("to_class"))))
    full = cells.join(F.broadcast(total), ["from_class", "to_class"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return full.withColumn("total_from", F.sum("n").over(Window.partitionBy("from_class")))


def matrix_percent(full: DataFrame) -> DataFrame:
    """Row-normalised per cent with two decimals; null for a class that is never a source."""
    return full.select("from_class", "to_class", F.bround(F.try_divide(F.lit(100.0) * F.col("n"), F.col("total_from")), 2).alias("pct"))


def change_rates(df: DataFrame) -> DataFrame:
    """(interval, n_valid_both, n_changed, change_rate_pct) of each interval."""
    by = valid(df).groupBy("from_year", "to_year").agg(F.count("*").alias("n_valid_both"), F.count_if(F.col("from_class") != F.col("to_class")).alias("n_changed"))
    return by.select(F.concat_ws("-", "from_year", "to_year").alias("interval"), "n_valid_both", "n_changed", F.bround(F.lit(100.0) * F.col("n_changed") / F.col("n_valid_both"), 2).alias("change_rate_pct"))


def candidates(counts: DataFrame, least: int = 5000, percent: float = 0.05) -> DataFrame:
    """Changes that are frequent over all windows: (from_class, to_class, total, pct of all rows)."""
    total = counts.groupBy("from_class", "to_class").agg(F.sum("n").alias("total"))
    every = total.agg(F.sum("total").alias("every"))
    out = total.crossJoin(F.broadcast(every)).select("from_class", "to_class", "total", F.bround(F.lit(100.0) * F.col("total") / F.col("every"), 4).alias("pct"))
    return out.where((F.col("from_class") != F.col("to_class")) & (F.col("total") >= least) & (F.col("pct") >= percent))


def concentration(counts: DataFrame, share: float = 60.0) -> DataFrame:
    """Each change's window of most rows (ties to the earliest), its share in per cent, and whether it exceeds ``share``."""
    by = counts.where("from_class <> to_class").groupBy("from_class", "to_class").agg(F.sum("n").alias("total"), F.max("n").alias("most"), F.max_by("from_year", F.struct(F.col("n"), -F.col("from_year"))).alias("top_window"))
    pct = F.bround(F.lit(100.0) * F.col("most") / F.col("total"), 2)
    return by.select("from_class", "to_class", "total", "top_window", pct.alias("share"), (pct > share).alias("concentrated"))


def stable_and_changed(counts: DataFrame) -> DataFrame:
    """(from_year, stable, changed): the rows of each window that kept and that changed class."""
    kept = F.col("from_class") == F.col("to_class")
    return counts.groupBy("from_year").agg(F.sum(F.when(kept, F.col("n")).otherwise(0)).alias("stable"), F.sum(F.when(~kept, F.col("n")).otherwise(0)).alias("changed"))


def directions(counts: DataFrame, scheme: str = "gradient") -> DataFrame:
    """(direction, n) of all changes under a scheme."""
    rule = {"gradient": direction_gradient, "strict": direction_strict}[scheme]
    return counts.where("from_class <> to_class").groupBy(rule(F.col("from_class"), F.col("to_class")).alias("direction")).agg(F.sum("n").alias("n"))


def recovery_ratio(directed: DataFrame) -> DataFrame:
    """Recovery over degradation, the divisor at least 1."""
    part = lambda d: F.coalesce(F.sum(F.when(F.col("direction") == d, F.col("n"))), F.lit(0))
    return directed.agg(part("recovery").alias("recovery"), part("degradation").alias("degradation"), F.bround(part("recovery") / F.greatest(part("degradation"), F.lit(1)), 6).alias("ratio"))


def previous_class(maps: DataFrame, step: int = 5) -> DataFrame:
    """(pix, year, class, class_prev, change_flag): 1 changed, 0 same, null where either class is 0 or missing."""
    before = maps.select("pix", (F.col("year") + step).alias("year"), F.col("class").alias("class_prev"))
    both = maps.select("pix", "year", "class").join(before, ["pix", "year"], "left")
    known = (F.col("class") > 0) & (F.col("class_prev") > 0)
    return both.withColumn("change_flag", F.when(known, (F.col("class") != F.col("class_prev")).cast("int")))

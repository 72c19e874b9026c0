"""Exact quantiles of any number of values: first the range that holds a rank, then the values of that range.

Ranges are steps of the values' logarithm, 1,024 to an octave. Counting them is one aggregation whose result is
bounded by the ranges; only the values of the few ranges that hold a wanted rank are looked at again. So
no task sees all values, and equal values are one row before they are sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def log_range(v: Column) -> Column:
    """Integer that grows with the value: its range of the logarithm, apart for either sign, zero between them."""
    size = F.floor(F.log2(F.abs(v)) * 1024)
    return F.when(v == 0, F.lit(0).cast("long")).when(v > 0, size + 10_000_000).otherwise(-size - 10_000_000)


def exact_quantiles(df: DataFrame, value: str, shares: Sequence[float], *keys: str) -> DataFrame:
    """(keys, q0, q1, ..): the values at these shares of each group's given values, linear between neighbours in rank.

    Null and not-a-number values don't count; groups without values have no row (without keys there is one, of nulls)."""
    v = F.col(value).cast("double")
    rows = df.where(v.isNotNull() & ~F.isnan(v)).select(*keys, v.alias("_v"), log_range(v).alias("_b"))
    family = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    ranges = rows.groupBy(*keys, "_b").agg(F.count("*").alias("_c"))
    ranges = ranges.withColumns({"_upto": F.sum("_c").over(family.orderBy("_b")), "_n": F.sum("_c").over(family)})
    # The ranks of each share, from 0: the one below and the one above its place.
    place = lambda s: F.lit(float(s)) * (F.col("_n") - 1)
    ranks = F.array(*(F.struct(F.lit(i).alias("q"), f(place(s)).cast("long").alias("rank")) for i, s in enumerate(shares) for f in (F.floor, F.ceil)))
    wanted = ranges.select("*", F.inline(ranks)).where((F.col("rank") < F.col("_upto")) & (F.col("rank") >= F.col("_upto") - F.col("_c")))
    wanted = wanted.select(*keys, "_b", "_n", "q", "rank", (F.col("_upto") - F.col("_c")).alias("_before")).distinct()
    held = wanted.groupBy(*keys, "_b").agg(F.first("_before").alias("_before"), F.first("_n").alias("_n"), F.collect_set(F.struct("q", "rank")).alias("_ranks"))
    values = rows.join(held, [*keys, "_b"]).groupBy(*keys, "_b", "_v").agg(F.count("*").alias("_c"), F.first("_before").alias("_before"), F.first("_n").alias("_n"), F.first("_ranks").alias("_ranks"))
    upto = F.sum("_c").over(Window.partitionBy(*keys, "_b").orderBy("_v")) + F.col("_before")
    hits = values.withColumn("_upto", upto).select(*keys, "_v", "_n", "_c", "_upto", F.inline("_ranks")).where((F.col("rank") < F.col("_upto")) & (F.col("rank") >= F.col("_upto") - F.col("_c")))

    def between(i: int, share: float) -> Column:
        at = F.lit(float(share)) * (F.max("_n") - 1)
        own = F.when(F.col("q") == i, F.col("_v"))
        return (F.min(own) + (F.max(own) - F.min(own)) * (at - F.floor(at))).alias(f"q{i}")

    return hits.groupBy(*keys).agg(*(between(i, s) for i, s in enumerate(shares)))

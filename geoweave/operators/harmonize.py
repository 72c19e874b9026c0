"""Native product codes to the unified legend, and checks of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoweave.operators.quantiles import exact_quantiles


def remap(votes: DataFrame, crosswalk: DataFrame, keys: tuple[str, ...] = ("product_id",), native: str = "native") -> DataFrame:
    """``votes`` with ``unified``; codes that the crosswalk lacks become 0. The crosswalk is a constant table and is broadcast."""
    dim = F.broadcast(crosswalk.select(*keys, F.col(native), "unified"))
    return votes.join(dim, [*keys, native], "left").withColumn("unified", F.coalesce("unified", F.lit(0)))


def histogram(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, n): rows of each value."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def histogram_shares(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """(keys, value, n, pct, rank): rows of each value within ``keys``, its share in per cent (2 digits, halves to even), most frequent first, ties to the least value."""
    counts = histogram(df, *keys, value)
    total = F.sum("n").over(Window.partitionBy(*keys))
    order = Window.partitionBy(*keys).orderBy(F.desc("n"), value)
    return counts.select(*keys, value, "n", F.bround(F.lit(100.0) * F.col("n") / total, 2).alias("pct"), F.row_number().over(order).alias("rank"))


def most_frequent(df: DataFrame, k: int, *keys: str) -> DataFrame:
    """The ``k`` most frequent values, a report of that size; ties to the least."""
    return histogram(df, *keys).orderBy(F.desc("n"), *keys).limit(k)


def unknown_codes(votes: DataFrame, crosswalk: DataFrame, keys: tuple[str, ...] = ("product_id", "native")) -> DataFrame:
    """Codes outside the official legend, with their rows."""
    return histogram(votes.join(F.broadcast(crosswalk.select(*keys)), list(keys), "left_anti"), *keys)


def crosstab(df: DataFrame, row: str, column: str) -> DataFrame:
    """Contingency in long form: n, the row's total, its dominant column (ties to the least) and the dominant share in per cent."""
    cells = df.groupBy(row, column).agg(F.count("*").alias("n"))
    rows = cells.groupBy(row).agg(F.sum("n").alias("row_total"), F.max_by(column, F.struct(F.col("n"), -F.col(column))).alias("dominant"), F.max("n").alias("most"))
    joined = cells.join(rows, row)
    return joined.select(row, column, "n", "row_total", "dominant", F.round(F.lit(100.0) * F.col("most") / F.col("row_total"), 1).alias("dominant_pct"))


def band_of(year: Column, bands: Column, early_file: Column) -> Column:
    """Band of a year in a multi-band file.

    The early file has 1985, 1990 and 1995 in three bands (other years: the last); the late
    one 2000 to 2022 in 23 (clamped). Files with other numbers of bands get the band in
    proportion; halves go to the even band."""
    early = F.when(bands == 3, F.when(year == 1985, 1).when(year == 1990, 2).when(year == 1995, 3).otherwise(bands))
    early = early.otherwise(F.greatest(F.lit(1), F.least(bands, F.bround(1 + (year - 1985) / F.lit(10.0) * (bands - 1)).cast("int"))))
    late = F.when(bands == 23, F.greatest(F.lit(1), F.least(F.lit(23), year - 1999)))
    late = late.otherwise(F.greatest(F.lit(1), F.least(bands, F.bround(1 + (year - 2000) / F.lit(22.0) * (bands - 1)).cast("int"))))
    return F.when(early_file, early).otherwise(late).cast("int")


def year_in_name(name: Column) -> Column:
    """The first four digits of a file name as a year; null where there are none."""
    found = F.regexp_extract(name, r"(\d{4})", 1)
    return F.when(found != "", found.cast("int"))


def resolve_files(files: DataFrame, keys: tuple[str, ...] = ("product", "year"), priority: str = "priority") -> DataFrame:
    """Of the files that can give a product and year, the one of least priority (ties to the first path)."""
    best = F.min_by(F.struct(*[c for c in files.columns if c not in keys]), F.struct(priority, "path")).alias("_best")
    return files.groupBy(*keys).agg(best).select(*keys, "_best.*")


def describe_continuous(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """Minimum, maximum, mean, population deviation, 5th and 95th percentile, given and missing rows. NaN counts as missing."""
    v = F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))
    by = df.groupBy(*keys).agg(F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.count(v).alias("n_valid"), (F.count("*") - F.count(v)).alias("n_null"))
    tails = exact_quantiles(df, value, (0.05, 0.95), *keys).withColumnsRenamed({"q0": "p5", "q1": "p95"})
    out = by.join(tails, list(keys), "left") if keys else by.join(tails, how="left")
    return out.select(*keys, "min", "max", "mean", "std", "p5", "p95", "n_valid", "n_null")

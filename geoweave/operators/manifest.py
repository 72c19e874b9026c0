"""What has been made from what: a table of digests, so that a run makes only what is stale.

An entry names a step, a product and a year and holds the digest of the settings and of the rows that the
output was made from. Wanted outputs are the digests of the present inputs; those without an equal entry are stale.
Outputs are written partition by partition, so a changed product replaces its own years and nothing else.
Entries are appended after the output is there: a run that is lost in between is done again.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "step string, product string, year int, digest string, at timestamp"


def digests(inputs: DataFrame, step: str, settings: Mapping[str, object], product: str = "product", year: str = "year") -> DataFrame:
    """(step, product, year, digest): for each product and year of ``inputs``, a digest of the settings and of its rows in whatever order.

    Rows are told apart by a hash of all columns; their number and the sum and the exclusive-or of two hashes stand for the multiset."""
    columns = [F.col(f"`{c}`") for c in sorted(inputs.columns)]
    row = F.xxhash64(*columns)
    other = F.xxhash64(F.lit("other"), *columns)
    by = inputs.groupBy(F.col(product).cast("string").alias("product"), F.col(year).cast("int").alias("year")).agg(F.count("*").alias("n"), F.sum(row.cast("decimal(38,0)")).alias("s"), F.bit_xor(other).alias("x"))
    named = json.dumps(dict(sorted(settings.items())), sort_keys=True, default=str) + json.dumps(sorted(inputs.dtypes))
    return by.select(F.lit(step).alias("step"), "product", "year", F.sha2(F.concat_ws("|", F.lit(named), F.col("n").cast("string"), F.col("s").cast("string"), F.col("x").cast("string")), 256).alias("digest"))


def entries(spark: SparkSession, path: str) -> DataFrame:
    """The last entry of every (step, product, year)."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], SCHEMA)
    last = Window.partitionBy("step", "product", "year").orderBy(F.desc("at"), "digest")
    return spark.read.schema(SCHEMA).parquet(path).withColumn("_k", F.row_number().over(last)).where("_k = 1").drop("_k")


def stale(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """Wanted outputs that no entry with the same digest covers."""
    return wanted.join(known.select("step", "product", "year", "digest"), ["step", "product", "year", "digest"], "left_anti")


def record(made: DataFrame, path: str) -> None:
    made.select("step", "product", "year", "digest", F.current_timestamp().alias("at")).write.mode("append").parquet(path)


def gone(known: DataFrame, wanted: DataFrame, step: str) -> DataFrame:
    """Entries of a step whose input is no longer there."""
    return known.where(F.col("step") == step).join(wanted.select("step", "product", "year"), ["step", "product", "year"], "left_anti")


def refresh(spark: SparkSession, manifest: str, step: str, inputs: DataFrame, make: Callable[[DataFrame], DataFrame], output: str, settings: Mapping[str, object] | None = None, *, product: str = "product", year: str = "year", force: bool = False) -> list[tuple[str, int]]:
    """Make the outputs of a step that are stale and give their (product, year), sorted.

    ``make`` turns the stale inputs into output rows with the same product and year columns; only these partitions of the Parquet
    table ``output`` are replaced. With ``force`` everything is made. The number of products and years is small against the rows."""
    wanted = digests(inputs, step, settings or {}, product, year)
    due = wanted if force else stale(wanted, entries(spark, manifest))
    rows = due.collect()
    if not rows:
        return []
    listed = spark.createDataFrame(rows, wanted.schema)
    keys = listed.select(F.col("product").alias("_p"), F.col("year").alias("_y"))
    old = inputs.join(F.broadcast(keys), (F.col(product).cast("string") == F.col("_p")) & (F.col(year).cast("int") == F.col("_y")), "left_semi")
    make(old).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(product, year).parquet(output)
    record(listed, manifest)
    return sorted((r["product"], r["year"]) for r in rows)


def run(spark: SparkSession, manifest: str, steps: Sequence[tuple[str, Callable[[], DataFrame], Callable[[DataFrame], DataFrame], str, Mapping[str, object]]], **columns: str) -> dict[str, list[tuple[str, int]]]:
    """Steps one after the other: (name, inputs, make, output, settings); ``inputs`` is called when the step's turn comes, so it reads what the steps before wrote."""
    return {name: refresh(spark, manifest, name, inputs(), make, output, settings, **columns) for name, inputs, make, output, settings in steps}

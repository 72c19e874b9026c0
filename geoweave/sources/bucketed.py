"""Maps stored in buckets of pixels, so that years of one map meet without a shuffle."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoweave.sources import catalog


def write(df: DataFrame, key: str, buckets: int, name: str | None = None, path: str | None = None) -> str:
    """Store a table in ``buckets`` buckets of ``key``, sorted by it, and give its name in the catalog. Rows are dealt once, so a bucket is one file."""
    spark = df.sparkSession
    name = name or f"map_{uuid.uuid4().hex}"
    dealt = df.repartition(buckets, key)
    dealt.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", path or f"{catalog.scratch(spark)}-{name}").saveAsTable(name)
    return name


def year_pairs(spark: SparkSession, name: str, key: str = "pix", step: int = 5, value: str = "class", confidence: str = "conf") -> DataFrame:
    """(key, from_year, to_year, from_class, to_class, conf_from, conf_to) of each pixel's years ``step`` apart.

    Both sides are the bucketed table and join on its key alone; the years are compared behind the join (a pixel has few), as a
    second key would ask for another distribution. There is no exchange in the plan."""
    a = spark.table(name).select(key, F.col("year").alias("from_year"), F.col(value).alias("from_class"), F.col(confidence).alias("conf_from"))
    b = spark.table(name).select(key, F.col("year").alias("to_year"), F.col(value).alias("to_class"), F.col(confidence).alias("conf_to"))
    return a.join(b.hint("merge"), key).where(F.col("to_year") - F.col("from_year") == step)

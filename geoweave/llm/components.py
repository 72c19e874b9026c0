"""Connected components of a link table, by alternating large and small stars.

Every round is two aggregations and two joins on the links; nothing is collected and each
round's links are written to the shared folder. The number of rounds grows with the
logarithm of the longest path. A node with very many links is one hot join key, which
Spark's skew join splits; minima are pre-aggregated before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoweave.llm.common import discard, stored


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """``links`` (u, v) of any orderable type, no nulls; gives (node, root) for each linked node.

    The root is the least node of the component; it has a row of its own. No links: no rows."""
    held = stored(links.select("u", "v").where("u <> v").distinct(), name)
    mark = _mark(held)
    while mark[0]:
        after = stored(_small_star(_large_star(held)), name)
        new = _mark(after)
        discard(held)
        held, same, mark = after, new == mark, new
        if same:
            break
    return held.select(F.col("u").alias("node"), F.col("v").alias("root")).union(held.select("v", "v").distinct())

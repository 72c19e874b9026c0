"""Registry of queries: a function over views and the SQL that an oracle runs for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from geoweave.plans.views import oracle, spark_view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
View = Callable[[str], DataFrame]


def query(sql: str | None = None, name: str | None = None, paths: bool = False) -> Callable:
    """Register a function (spark, view) under its name; ``view`` gives a table or view by name. With ``paths`` it gets the folder of the tables, too."""

    def add(f: Callable[..., DataFrame]) -> Callable:
        key = name or f.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            held: dict[str, DataFrame] = {}
            return f(spark, lambda v: spark_view(spark, sf_dir, v, held), *([sf_dir] if paths else []))

        run.__name__, run.__doc__ = key, f.__doc__
        QUERIES[key] = run
        if sql:
            ORACLES[key] = oracle(sql)
        return f

    return add

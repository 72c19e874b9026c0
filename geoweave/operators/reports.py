"""Small tables that reports are made of: shares over limits, capped displays, attributions side by side, digests."""

from __future__ import annotations

import hashlib
import json
import platform
import shutil
import time
from collections.abc import Callable, Mapping, Sequence
from importlib.util import find_spec

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoweave.operators.quantiles import exact_quantiles


def without_water(df: DataFrame, label: str, value: str, water: Sequence[int], flag: str = "is_water") -> DataFrame:
    """Values of water cells become null; ``flag`` tells which they were."""
    inside = F.col(label).isin(*water)
    return df.withColumns({flag: F.coalesce(inside, F.lit(False)), value: F.when(~F.coalesce(inside, F.lit(False)), F.col(value))})


def display_cap(df: DataFrame, value: str, share: float = 0.99, name: str = "shown") -> DataFrame:
    """Adds the value cut at the percentile ``share`` of all given ones, for maps with few very great ones."""
    cap = exact_quantiles(df, value, [share]).select(F.col("q0").alias("_cap"))  # one row
    return df.join(F.broadcast(cap), how="left").withColumn(name, F.least(F.col(value), F.col("_cap"))).drop("_cap")


def centre(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """(keys, mean, median)."""
    means = df.groupBy(*keys).agg(F.avg(value).alias("mean"))
    return means.join(exact_quantiles(df, value, [0.5], *keys).withColumnRenamed("q0", "median"), list(keys), "left")


def shares_over(df: DataFrame, value: str, limits: Sequence[float]) -> DataFrame:
    """(limit, n, pct): how many given values lie over each limit, of all rows; one aggregation."""
    counts = [F.count_if(F.col(value) > limit).alias(f"_{i}") for i, limit in enumerate(limits)]
    one = df.agg(F.count("*").alias("_n"), *counts)
    rows = F.array(*(F.struct(F.lit(float(limit)).alias("limit"), F.col(f"_{i}").alias("n")) for i, limit in enumerate(limits)))
    return one.select("_n", F.inline(rows)).select("limit", "n", F.round(F.try_divide(F.lit(100.0) * F.col("n"), F.col("_n")), 4).alias("pct"))


def side_by_side(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str, names: tuple[str, str] = ("a", "b")) -> DataFrame:
    """(keys, a, b): the value of either table, 0 where one lacks the keys."""
    left, right = (d.select(*keys, F.col(value).alias(n)) for d, n in zip((a, b), names))
    return left.join(right, list(keys), "full").na.fill(0.0, list(names))


def attention_by_step(df: DataFrame, step: str = "step", weight: str = "weight") -> DataFrame:
    """(step, mean_weight, n): what each step of the window weighs on average over nodes."""
    return df.groupBy(step).agg(F.avg(weight).alias("mean_weight"), F.count(weight).alias("n"))


def digest(**settings: Column) -> Column:
    """First ten digits of the SHA-1 of settings as JSON with sorted names."""
    return F.substring(F.sha1(F.to_json(F.struct(*(settings[k].alias(k) for k in sorted(settings))), {"ignoreNullFields": "false"})), 1, 10)


def settings_digest(settings: Mapping[str, object]) -> str:
    """The same of a plain dictionary."""
    return hashlib.sha1(json.dumps(dict(settings), sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:10]


def placemarks(points: DataFrame, name: str, lon: str, lat: str, text: str) -> DataFrame:
    """(name, kml): one KML placemark for each point, for reports of a bounded number of points."""
    escaped = lambda c: F.replace(F.replace(F.replace(F.col(c).cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    mark = F.format_string("<Placemark><name>%s</name><description>%s</description><Point><coordinates>%.6f,%.6f,0</coordinates></Point></Placemark>", escaped(name), escaped(text), F.col(lon), F.col(lat))
    return points.select(F.col(name).alias("name"), mark.alias("kml"))


def kml(marks: DataFrame, title: str) -> str:
    """A KML document of placemarks; they are collected, so their number is the caller's bound."""
    body = "\n".join(r.kml for r in marks.orderBy("name").collect())
    return f'<?xml version="1.0" encoding="UTF-8"?>\n<kml xmlns="http://www.opengis.net/kml/2.2"><Document><name>{title}</name>\n{body}\n</Document></kml>'


def diagnosis(title: str, sections: Mapping[str, DataFrame], rows: int = 100) -> str:
    """A Markdown report: one heading and table for each section, cut at ``rows``."""
    from geoweave.sources.catalog import markdown

    return "\n\n".join([f"# {title}", *(f"## {name}\n\n{markdown(df, rows)}" for name, df in sections.items())]) + "\n"


# Published results of the two training sets, for tables that set own results beside them.
PUBLISHED = (
    ("A", "confidence 80 or more at both ends", 3_240_000, 12, 82.2, 0.597, 0.813),
    ("B", "all pixels", 4_590_000, 13, 77.8, 0.600, 0.772),
)


def published(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PUBLISHED), "training_set string, rows_used string, n_rows long, n_classes int, accuracy_pct double, macro_f1 double, weighted_f1 double")


def environment(spark: SparkSession, packages: Sequence[str] = ("numpy", "pandas", "pyarrow"), folder: str = "/", free_gb: float = 1.0) -> DataFrame:
    """(name, found, ok): what a run needs on the driver."""
    rows = [("python", platform.python_version(), True), ("spark", spark.version, spark.version >= "4")]
    rows += [(p, "present" if find_spec(p) else "missing", find_spec(p) is not None) for p in packages]
    free = shutil.disk_usage(folder).free / 1e9
    rows.append(("free space", f"{free:.0f} GB", free >= free_gb))
    return spark.createDataFrame(rows, "name string, found string, ok boolean")


def run_steps(steps: Sequence[tuple[str, Callable[[], object]]], *, first: str | None = None, last: str | None = None, done: Callable[[str], bool] = lambda _: False, force: bool = False) -> list[tuple[str, str, float]]:
    """(step, state, seconds) of each step in order, from ``first`` to ``last``.

    A step whose output exists (``done``) is skipped unless forced; after a failure the rest is not run."""
    names = [n for n, _ in steps]
    a, b = names.index(first) if first else 0, names.index(last) if last else len(names) - 1
    out: list[tuple[str, str, float]] = []
    for name, make in steps[a : b + 1]:
        began = time.time()
        if not force and done(name):
            state = "skipped"
        else:
            try:
                make()
                state = "done"
            except Exception as e:
                state = f"failed: {type(e).__name__}: {e}"
        out.append((name, state, round(time.time() - began, 3)))
        if state.startswith("failed"):
            break
    return out

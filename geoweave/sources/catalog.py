"""Where tables are and how they are written."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoweave.operators.harmonize import resolve_files, year_in_name


def read_pixels(spark: SparkSession, path: str, *, columns: Sequence[str] = (), **equal: object) -> DataFrame:
    """A pixel table; equalities on partition columns prune files, the column list prunes columns."""
    df = spark.read.parquet(path)
    for name, value in equal.items():
        df = df.where(F.col(name).isin(list(value)) if isinstance(value, (list, tuple, range)) else F.col(name) == value)
    return df.select(*columns) if columns else df


def years_between(layers: DataFrame, variable: str, first: int, last: int) -> DataFrame:
    """All years of a variable in a range that exist; a missing year is no error."""
    return layers.where((F.col("variable") == variable) & F.col("year").between(first, last))


def resolved(df: DataFrame, names: Mapping[str, Sequence[str]]) -> DataFrame:
    """The wanted columns, each by the first of its possible names that the table has, whatever their case.

    Raises ValueError where a table has none of a column's names."""
    have = {c.lower(): c for c in df.columns}
    found = {want: next((have[n.lower()] for n in options if n.lower() in have), None) for want, options in names.items()}
    if missing := [n for n, c in found.items() if c is None]:
        raise ValueError(f"none of {[names[n] for n in missing]} among {df.columns}")
    return df.select(*(F.col(f"`{c}`").alias(n) for n, c in found.items()))


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share, under ``spark.checkpoint.dir``; a local one only on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="geoweave-")
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a new shared folder and read back: its lineage ends there. :func:`discard` deletes it."""
    path = f"{scratch(df.sparkSession)}-{name}"
    df.write.parquet(path)
    held = df.sparkSession.read.schema(df.schema).parquet(path)
    held._stored_path = path
    return held


def discard(df: DataFrame) -> None:
    """Delete the files of a frame from :func:`stored` that nothing reads any more."""
    path = getattr(df, "_stored_path", None)
    if path:
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def available_years(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, "year").where("year IS NOT NULL").distinct()


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=True)


def file_years(files: DataFrame, name: str = "path") -> DataFrame:
    """Files with the year in their name; files without one go."""
    return files.withColumn("year", year_in_name(F.element_at(F.split(F.col(name), "/"), -1))).where("year IS NOT NULL")


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, length) of files, listed by Spark's own file source so that any store works."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder).select("path", "length")


def catalog(files: DataFrame) -> DataFrame:
    """One file for each product and year, by template priority."""
    return resolve_files(files)


def write_pixels(df: DataFrame, path: str, partition: Sequence[str] = ("year",), force: bool = True) -> None:
    """Parquet, zstandard, one folder for each year; only the years in ``df`` are replaced. Without ``force`` existing tables stay."""
    mode = "overwrite" if force else "ignore"
    df.write.mode(mode).option("compression", "zstd").option("partitionOverwriteMode", "dynamic").partitionBy(*partition).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def markdown(df: DataFrame, rows: int = 100) -> str:
    """A small table as Markdown; a report, so it is cut at ``rows``."""
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in df.limit(rows).collect()])


def latex(df: DataFrame, rows: int = 100) -> str:
    body = [" & ".join("" if v is None else str(v) for v in r) + r" \\" for r in df.limit(rows).collect()]
    return "\n".join([r"\begin{tabular}{" + "l" * len(df.columns) + "}", " & ".join(df.columns) + r" \\ \hline", *body, r"\end{tabular}"])

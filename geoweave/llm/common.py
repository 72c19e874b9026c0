"""Shared plumbing of the training-data operators.

Rules every operator follows:

* it takes the columns it needs by their place (:func:`picked`), so extra columns with any
  name, even one that differs in case only or that holds dots, and of any type are harmless;
* texts travel to Python as Arrow batches and are handled one document at a time;
* intermediate tables go to the folder of ``spark.checkpoint.dir``, which driver and
  executors share, so a lost executor costs a re-read and not a recomputation.
"""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch; texts can be long, so the default of 10,000 is too many.
ARROW_ROWS = 1024


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where none is set, one machine alone (a local master) uses
    a folder of its own, as in tests; a cluster raises an error, for its executors share no such folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext.getCheckpointDir()
        if not held:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="geoweave-"))
            held = spark.sparkContext.getCheckpointDir()
        base = held
    return base.rstrip("/")


def prepare(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch unless the session already does.

    The setting counts when a query runs, after the operator returned, so it stays with the session."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, None) in (None, "10000"):
        spark.conf.set(key, str(ARROW_ROWS))


#: Tables that were stored on the way to a result, for each :func:`settled` under way.
_scopes: list[list[str]] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: the lineage ends here."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/geoweave/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _scopes:
        _scopes[-1].append(path)
    held = spark.read.schema(df.schema).parquet(path)
    held._geoweave_path = path
    return held


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(df: DataFrame) -> None:
    """Delete the files of a frame from :func:`stored` that nothing reads any more."""
    path = getattr(df, "_geoweave_path", None)
    if path:
        _delete(df.sparkSession, path)


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """``stored(make(), name)``, and the tables that ``make`` stored on the way are deleted: nothing reads them any more."""
    _scopes.append([])
    try:
        df = stored(make(), name)
    finally:
        paths = _scopes.pop()
    for path in paths[:-1]:
        _delete(df.sparkSession, path)
    if _scopes:
        _scopes[-1].append(paths[-1])
    return df


def place(df: DataFrame, name: str) -> int:
    """Place of a column: of the one with this very name, else of the one that differs in case only."""
    same = [i for i, c in enumerate(df.columns) if c == name] or [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
    if not same:
        raise ValueError(f"no column {name}: {df.columns}")
    return same[0]


def numbered(df: DataFrame) -> DataFrame:
    """The columns as ``_0``, ``_1`` and so on, whatever their names."""
    return df.toDF(*(f"_{i}" for i in range(len(df.columns))))


def picked(df: DataFrame, *names: str) -> DataFrame:
    """Only these columns."""
    return numbered(df).select(*(F.col(f"_{place(df, n)}").alias(n) for n in names))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release_memory() -> None:
    """Give freed memory back to the system: a worker lives on between tasks, beside others on its machine."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without making Python strings of them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return pc.cast(column, kind).to_pylist()


def per_document(docs: DataFrame, row: Callable[[object, object], tuple], schema: str, *, raw: bool = False, text: str = "text") -> DataFrame:
    """One output row for each document: ``row(doc_id, text)`` gives its values.

    ``raw`` hands over UTF-8 bytes instead of a string. No shuffle, one pass.
    """
    prepare(docs.sparkSession)
    out = docs.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = as_bytes(batch.column(1)) if raw else batch.column(1).to_pylist()
            rows = [row(i, t) for i, t in zip(ids, texts)]
            columns = list(zip(*rows)) if rows else [[] for _ in arrow]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return picked(docs, "doc_id", text).select("doc_id", F.col(text).cast("string").alias("text")).mapInArrow(run, out)


def passed_through(docs: DataFrame, run: Callable[[Iterable[pa.RecordBatch], int], Iterator[pa.RecordBatch]], *names: str) -> DataFrame:
    """``docs`` through ``run(batches, *places of these columns)``, with the columns that they had."""
    prepare(docs.sparkSession)
    at = [place(docs, n) for n in names]
    held = numbered(docs)
    return held.mapInArrow(lambda batches: run(batches, *at), held.schema).toDF(*docs.columns)


def with_texts(columns: list[pa.Array], at: int, size: int | None, texts: list[str | None], changed: Iterable[bool]) -> pa.RecordBatch:
    """The columns with other texts; where a text changed, the column ``size`` counts its characters."""
    columns[at] = pa.array(texts, columns[at].type)
    if size is not None:
        counts = [(None if t is None else len(t)) if new else old for t, new, old in zip(texts, changed, columns[size].to_pylist())]
        columns[size] = pa.array(counts, columns[size].type)
    return pa.RecordBatch.from_arrays(columns, names=[f"_{i}" for i in range(len(columns))])


def size_column(docs: DataFrame) -> int | None:
    """Place of ``n_chars`` where it is a column of numbers."""
    from pyspark.sql.types import IntegralType

    return next((i for i, f in enumerate(docs.schema.fields) if f.name == "n_chars" and isinstance(f.dataType, IntegralType)), None)


def replace_texts(docs: DataFrame, edit: Callable[[str], str]) -> DataFrame:
    """The documents with ``edit`` applied to every non-null text, all columns; ``n_chars`` follows where a text changed."""
    size = size_column(docs)

    def run(batches: Iterable[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old = batch.column(at).to_pylist()
            new = [None if t is None else edit(t) for t in old]
            yield with_texts(list(batch.columns), at, size, new, [a != b for a, b in zip(old, new)])

    return passed_through(docs, run, "text")

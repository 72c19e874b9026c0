"""Documents to token-id files and back.

Documents are dealt out by ranges of doc_id and sorted within them, so the files hold the
ids in ascending doc_id order (null first; equal ids by text). Every range is encoded into
frames of whole documents (see :mod:`geoweave.llm.codec`) as it streams by; a frame is a
row of a Parquet container, which gives the files Spark's commit protocol and any store
that Spark can write. Reading decodes and verifies frames one at a time.

Memory is one frame and one Arrow batch; a lost executor repeats its range only.
Defined results: a null text is empty; every document has at least its end id; an empty
table gives an empty container and no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geoweave.llm.codec import BLOCK, decode_frame, encode_frame
from geoweave.llm.common import picked, prepare, release_memory, stored
from geoweave.llm.tokens import lots, tokenizer_path, word_tokenizer

END_ID = 1
#: Ids from which a frame is closed.
FRAME_IDS = 1 << 23
#: Bytes of text whose words are looked up together: the text of one range or so, as the same words come again in its lots.
TEXT_BYTES = 24 << 20
FRAME_SCHEMA = "part int, frame int, n_docs long, n_ids long, data binary"


def encode(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, frame_ids: int = FRAME_IDS, block: int = BLOCK) -> DataFrame:
    """The frames of the documents, in order of (part, frame)."""
    spark = docs.sparkSession
    prepare(spark)
    path = tokenizer or tokenizer_path()
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, frame, n_ids = TaskContext.get().partitionId(), 0, 0
        ids: list = []
        held: list[bytes] = []

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([frame], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([n_ids], pa.int64()), pa.array([encode_frame(ids, held, block)], pa.binary())],
                names=["part", "frame", "n_docs", "n_ids", "data"],
            )

        words = word_tokenizer(path)
        for doc_ids, texts in lots(batches, size=TEXT_BYTES):
            for doc_id, coded in zip(doc_ids.to_pylist(), words.encode(texts)):
                ids.append(doc_id)
                held.append(coded + end)
                n_ids += len(coded) // 4 + 1
                if n_ids >= frame_ids:
                    yield close()
                    frame, n_ids, ids, held = frame + 1, 0, [], []
            del doc_ids, texts
        if ids:
            yield close()
            ids, held = [], []
            release_memory()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = picked(docs, "doc_id", "text").select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, FRAME_SCHEMA)


def write(docs: DataFrame, path: str, **options) -> None:
    """Encode the documents and write the container."""
    encode(docs, **options).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FRAME_SCHEMA).parquet(path)


def decode(frames: DataFrame) -> DataFrame:
    """(part, frame, place, doc_id, before, ids) of every document: ``ids`` as little-endian
    unsigned 32-bit integers, ``before`` counts the ids of its frame before it."""
    prepare(frames.sparkSession)
    schema = "part int, frame int, place int, doc_id long, before long, ids binary"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, documents = decode_frame(row["data"])
                seen = 0
                for i in range(0, len(ids), 1024):
                    part, before = documents[i : i + 1024], []
                    for d in part:
                        before.append(seen)
                        seen += len(d) // 4
                    n = len(part)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row["part"]] * n, pa.int32()), pa.array([row["frame"]] * n, pa.int32()), pa.array(range(i, i + n), pa.int32()), pa.array(ids[i : i + n], pa.int64()), pa.array(before, pa.int64()), pa.array(part, pa.binary())],
                        names=["part", "frame", "place", "doc_id", "before", "ids"],
                    )

    return frames.select("part", "frame", "data").mapInArrow(run, schema)


def summarise(frames: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the decoded files.

    ``start`` counts all ids before the document. The ids before a frame come from the
    frames' own counts: totals of parts (one row for each range) in one window, frames of a
    part in another; ids are never shuffled."""
    prepare(frames.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "frame", "doc_id", "before", "n_tokens", "ids_crc32"]
        for batch in batches:
            for row in batch.to_pylist():
                ids, documents = decode_frame(row["data"])
                before, seen = [], 0
                for d in documents:
                    before.append(seen)
                    seen += len(d) // 4
                columns = [[row["part"]] * len(ids), [row["frame"]] * len(ids), ids, before, [len(d) // 4 for d in documents], [zlib.crc32(d) for d in documents]]
                del documents
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n in ("part", "frame") else pa.int64()) for n, c in zip(names, columns)], names=names)
                release_memory()

    found = frames.select("part", "frame", "data").mapInArrow(run, "part int, frame int, doc_id long, before long, n_tokens long, ids_crc32 long")
    sizes = frames.select("part", "frame", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    within = (F.sum("n_ids").over(Window.partitionBy("part").orderBy("frame")) - F.col("n_ids")).alias("frame_start")
    starts = sizes.select("part", "frame", within).join(parts, "part").select("part", "frame", (F.col("part_start") + F.col("frame_start")).alias("frame_start"))
    return found.join(starts, ["part", "frame"]).select("doc_id", (F.col("frame_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, **options) -> DataFrame:
    """Write the files in the shared folder, read them back and summarise them."""
    return summarise(stored(encode(docs, **options), "token-files"))

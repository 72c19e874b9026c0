"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
in the shared folder and read again as the docs of the next stage. All stages but the last
return the columns of ``documents``, also such with names and types that no operator knows; an
empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from geoweave.llm import packing, pii, quality, sentences, simhash
from geoweave.llm.common import discard, settled, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression bands or the base rules reject go.

    Null, empty and blank texts have no words and go; rows that agree are judged alike; a very long
    text is judged whole and by its chunks."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least doc_id stays.

    Rows that agree in doc_id and text leave one row; rows without a doc_id stay; null, empty and
    blank texts are one group."""
    return simhash.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sentences that a later occurrence of a repeated span covers go; documents stay.

    A null text stays null; of a text that only repeats others nothing is left, and it is empty;
    the first occurrence is that of the least doc_id (none is least) and place."""
    return sentences.drop_repeated(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind.

    A null text stays null; overlapping findings become one; documents stay."""
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents' pieces in training sequences.

    A null or empty text still has its end id and so a piece; repeated rows are pieces of their own;
    only texts beyond a sequence's length are cut."""
    return packing.best_fit_packing(docs)


STAGES = [
    ("quality", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("personal_data", personal_data),
    ("packing", packed),
]

#: Compression, fingerprints and trained models have no SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the whole table. What a stage stores on its way goes when its result is
    written, and that result goes when the next one is."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        made = settled(lambda: stage(spark, docs, sf_dir), f"pipeline-{name}")  # noqa: B023  used at once
        if before is not None:
            discard(before)
        docs = before = made
    return STAGES[-1][1](spark, docs, sf_dir)

"""The registered queries of the training-data operators: thin, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoweave.llm import base_sql, divergence, hnsw, language, negatives, packing, pii, quality, secrets, sentencepiece, sentences, shards, simhash, token_files
from geoweave.llm.common import table


def op1_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return hnsw.nearest(vectors, vectors.where("vec_id % 20 = 0"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(table(spark, sf_dir, "documents"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(table(spark, sf_dir, "documents"))


def op8_sentence_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.sentence_dedup(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.encode(table(spark, sf_dir, "documents"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op12_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_documents(table(spark, sf_dir, "documents"))


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


# The base columns of three operators once more, as SQL can express these.


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_quality(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def secrets_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def personal_data_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_hnsw, op2_secrets, op3_token_files, op4_packing, op5_quality, op6_pii, op7_language, op8_sentence_dedup, op9_simhash, op10_sentencepiece, op11_divergence, op12_shards, op13_negatives)
    return {f.__name__: f for f in (*every, quality_base, secrets_base, personal_data_base)}


def oracle_sql() -> dict[str, str]:
    """SQL of what is exact arithmetic; that of models, graphs, hashes, decoders and propagation can't be written."""
    return {"op11_divergence": base_sql.DIVERGENCE, "op13_negatives": base_sql.NEGATIVES, "quality_base": base_sql.QUALITY, "secrets_base": base_sql.SECRETS, "personal_data_base": base_sql.PERSONAL}

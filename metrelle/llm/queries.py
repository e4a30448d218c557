"""The registered queries of this subpackage: thin digests over its operators, with production parameters on whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from metrelle.llm import bpe, chat, decontamination, language, lexical, licenses, lines, near, neighbours, passages, pii, resampling, secrets


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op1_shared_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.digest(_table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(_table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.digest(_table(spark, sf_dir, "embeddings"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(_table(spark, sf_dir, "documents"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.digest(_table(spark, sf_dir, "documents"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.digest(_table(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(_table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digest(_table(spark, sf_dir, "documents"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest(_table(spark, sf_dir, "conversations"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_shared_passages, op2_pii, op3_byte_bpe, op4_neighbours, op5_licenses, op6_ngram_jaccard_join, op7_language, op8_secrets, op9_line_dedup, op10_decontamination, op11_resampling, op12_chat, op13_lexical_search)}
ORACLES = {
    "op6_ngram_jaccard_join": near.DIGEST_SQL,
    "op9_line_dedup": lines.DIGEST_SQL,
    "op10_decontamination": decontamination.DIGEST_SQL,
    "op11_resampling": resampling.DIGEST_SQL,
    "op12_chat": chat.DIGEST_SQL,
    "op13_lexical_search": lexical.DIGEST_SQL,
}

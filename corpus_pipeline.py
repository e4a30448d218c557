"""A corpus pipeline over `documents`: language ID, line dedup, near duplicates, decontamination, tokens.

Each stage takes all that its predecessor kept, written as Parquet and read again, so a stage that is lost with its executors
is made anew from files. run() puts these files below the shared folder that spark.checkpoint.dir names, and deletes those of
a stage once its successor's are written.

Defined results: a null text, an empty one and one without a letter are rejected by the first stage, whatever their language
column holds; texts of any length go through whole; rows with a null doc_id that have a text are kept by every stage, as
nothing can be told of them by id; rows that share a doc_id are kept or dropped together by near duplicates and
decontamination; of equal and near texts the smallest doc_id stays, and rows that repeat it stay with it; extra columns pass
all stages but the last, also such as clash with names used within; an empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from metrelle.llm import bpe, decontamination, language, lines, near
from metrelle.llm.common import discard, stored
from pyspark.sql import DataFrame, SparkSession


def _language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.drop_rejected(docs)


def _lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.dedup(docs)


def _near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near.keep_one(docs)


def _decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digest(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", _language),
    ("line_dedup", _lines),
    ("near_duplicates", _near),
    ("decontamination", _decontaminate),
    ("byte_bpe", _tokens),
]

#: The classifier of the first stage and the signatures of the third can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole of documents."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
        discard(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)

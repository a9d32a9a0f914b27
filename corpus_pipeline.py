"""The training-data pipeline over `documents`, in five stages.

Each stage takes all rows that the one before kept, read back from Parquet; all but the
last return the columns of `documents`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from pagestrata.llm import decontamination, language_id, mixing, ngram_join, pii
from pagestrata.llm.store import intermediates, removed, shared_folder


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not recognised go (no letters, or a posterior below 0.5, or
    bytes that cost too much in every learned language); null and empty texts are among them.
    Repeated rows stay or go together."""
    return language_id.recognised(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates stays: that with the smallest doc_id, one with
    an id before one without. Null and empty texts stay; rows that share a doc_id are told apart."""
    return ngram_join.keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go; rows that share a doc_id are judged apart.
    Null texts stay."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is replaced by tags; n_chars follows. All rows stay, repeated
    ones too; null texts stay null."""
    return pii.redacted(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with size, source_size, target and the words that the mix takes. Null
    texts have size 0, null sources are one source, repeated rows have a share each."""
    return mixing.with_shares(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("redact", redact),
    ("mix", mix),
]

#: SQL can't express the byte model of the first stage; tests hold all stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; each one's rows are written and read again. Of what is written on
    the way only the last stage's rows stay."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        with intermediates(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            removed(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs

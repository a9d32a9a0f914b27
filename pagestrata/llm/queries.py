"""The operators' queries over the shared tables: thin, whole-table, production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .decontamination import contaminated
from .language_id import languages
from .licenses import license_scan
from .mixing import mixed
from .ngram_join import ngram_components
from .pii import span_digest
from .quality import quality
from .token_counts import token_histogram
from .url_filter import judged
from .warc import archived


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(_table(spark, sf_dir, "documents"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the verdict follows from the distance; as a sum of doubles that is left out here
    return quality(_table(spark, sf_dir, "documents")).drop("distance")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(_table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_histogram(_table(spark, sf_dir, "documents"))


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_table(spark, sf_dir, "documents"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(_table(spark, sf_dir, "pages"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(_table(spark, sf_dir, "pages"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digest(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join,
        op2_benchmark_decontamination,
        op3_quality_rules,
        op4_language_id,
        op5_token_counts,
        op6_license_scans,
        op7_url_filters,
        op8_mixing,
        op9_warc,
        op10_pii,
    )
}

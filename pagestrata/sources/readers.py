"""Readers of raw blocks, and the dispatch by suffix."""

from __future__ import annotations

import re
from pathlib import Path, PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import RAW_BLOCKS, violations
from .pdf import metadata_of_pdfs, read_pdfs


def read_blocks(spark: SparkSession, path: str, form: str = "parquet", strict: bool = False) -> DataFrame:
    """Raw blocks from Parquet, JSON or another built-in format.

    Fields that are missing are null. strict: reading fails on a broken constraint
    (bbox corners, confidence, page number); else `violations` finds such rows.
    """
    found = spark.read.schema(RAW_BLOCKS).format(form).load(path)
    if not strict:
        return found
    # a filter, so that every query checks, whatever columns it reads
    broken = F.array_join(violations(), ",")
    return found.where(F.when(broken != "", F.raise_error(broken).cast("boolean")).otherwise(F.lit(True)))


def validated(path: str) -> str:
    """The path of one document; fails unless it is a file with the suffix .pdf."""
    suffix = PurePosixPath(path).suffix
    if suffix.lower() != ".pdf":
        raise ValueError(f"Unsupported file type: {suffix or '<none>'}")
    if not Path(path).is_file():
        raise FileNotFoundError(f"PDF file not found: {path}")
    return path


def no_pattern(path: str) -> str:
    """The path as file sources take it, which read some marks as patterns."""
    return re.sub(r"([\\\[\]{}*?])", r"\\\1", path)


def open_document(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Raw blocks and raw metadata of one document."""
    literal = no_pattern(validated(path))
    return read_pdfs(spark, literal), metadata_of_pdfs(spark, literal)


def blocks_of_turns(conversations: DataFrame) -> DataFrame:
    """Conversations as documents: a page each, a turn a block, without geometry."""
    name = F.format_string("conversation-%d", "conv_id")
    empty = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in RAW_BLOCKS}
    have = {
        "document_path": name.alias("document_path"),
        "document_id": name.alias("document_id"),
        "page_number": F.lit(1).alias("page_number"),
        "raw_ordinal": F.col("turn").cast("int").alias("raw_ordinal"),
        "text": F.col("text"),
    }
    return conversations.select(*(have.get(f.name, empty[f.name]) for f in RAW_BLOCKS))


def _replaced(old: str, new: str):
    return lambda part: F.replace(part, F.lit(old), F.lit(new))


def blocks_of_html(html_pages: DataFrame) -> DataFrame:
    """Web pages as documents: a page each, a paragraph-level element a block."""
    body = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<(script|style|head|nav)\b.*?</\1\s*>", "")
    parts = F.split(body, r"(?i)<(?:p|h[1-6]|li|div|br|tr|td|article|section|blockquote)\b[^>]*>")
    plain = F.transform(parts, lambda p: F.regexp_replace(p, r"<[^>]*>", ""))
    for entity, mark in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        plain = F.transform(plain, _replaced(entity, mark))
    name = F.format_string("page-%d", "page_id")
    rows = html_pages.select(name.alias("document_path"), F.posexplode(plain).alias("raw_ordinal", "text"))
    have = {"document_path": F.col("document_path"), "document_id": F.col("document_path").alias("document_id"), "page_number": F.lit(1).alias("page_number"), "raw_ordinal": F.col("raw_ordinal"), "text": F.col("text")}
    return rows.select(*(have.get(f.name, F.lit(None).cast(f.dataType).alias(f.name)) for f in RAW_BLOCKS))

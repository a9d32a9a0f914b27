"""Registered queries of the block engine; each returns scalar columns over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import any_mark, count, lines, match_text, normalize_text, share, starts_lower, words
from ..operators import furniture
from ..operators.figures import is_figure_caption
from ..operators.headings import heading_blocks, heading_features, is_contents_table
from ..operators.tables import table_features
from ..schema import FLAGS
from ..sinks.json import block_json
from ..sinks.markdown import page_lines
from ..sources.readers import blocks_of_html, blocks_of_turns
from ..sources.synthetic import blocks_of_orders, case_texts, metadata_of_orders
from . import document as plan


def _at() -> list:
    # columns need a session, which importing must not
    return [F.col("document_id"), F.col("page_number").cast("long").alias("page_number")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks_of_orders(_table(spark, sf_dir, "orders"))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.text_blocks(_raw(spark, sf_dir))


def _long(*names: str) -> list:
    return [F.col(n).cast("long").alias(n) for n in names]


def normalize_documents(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", normalize_text(F.col("text")).alias("normalized"))


def match_text_lines(spark, sf_dir):
    ws = match_text(F.col("text"))
    found = _table(spark, sf_dir, "documents").select("doc_id", ws.alias("ws"), lines(F.col("text")).alias("l"))
    return found.select("doc_id", "ws", F.size("l").cast("long").alias("n_lines"), F.array_join("l", "|").alias("joined_lines"))


def keywords_split(spark, sf_dir):
    found = plan.cleaned_metadata(metadata_of_orders(_table(spark, sf_dir, "orders")))
    m = F.col("metadata")
    return found.select(
        "document_path", m["title"].alias("title"), m["author"].alias("author"), m["subject"].alias("subject"),
        F.array_join(m["keywords"], "|").alias("keywords"), F.size(m["keywords"]).cast("long").alias("n_keywords"),
    )


def raw_blocks_scan(spark, sf_dir):
    return _texts(spark, sf_dir).select(*_at(), "id", *_long("block_index"), "normalized_text")


def page_ocr_status(spark, sf_dir):
    return plan.page_status(_raw(spark, sf_dir)).select(*_at(), "width", "height", "has_native_text", "requires_ocr")


def furniture_flags(spark, sf_dir):
    return _texts(spark, sf_dir).select(*_at(), "id", *FLAGS)


def furniture_summary(spark, sf_dir):
    n = [F.sum(F.col(f).cast("long")).alias(f"n_{f[8:]}") for f in FLAGS]
    return _texts(spark, sf_dir).groupBy(_at()[1]).agg(F.count("*").alias("n_blocks"), *n)


def _judged(spark, sf_dir):
    return heading_features(_texts(spark, sf_dir), plan.fallback_text())


def heading_predicate(spark, sf_dir):
    return _judged(spark, sf_dir).select(*_at(), "id", F.col("h_is_heading").alias("is_heading"), F.col("h_reason").alias("reason"))


def heading_levels(spark, sf_dir):
    return _judged(spark, sf_dir).where("h_is_heading").select(*_at(), "id", F.col("h_level").cast("long").alias("level"), F.col("h_number").alias("number"))


def heading_lines(spark, sf_dir):
    return heading_blocks(_texts(spark, sf_dir)).select(*_at(), "id", *_long("block_index", "sub_index", "level"), "text", "normalized_text")


def _ruled(rows, key):
    """Heading, table, figure and furniture rules over `text`."""
    rows = table_features(heading_features(rows, F.col("text")), F.col("text"))
    ws = F.col("t_ws")
    return rows.select(
        key, F.col("h_is_heading").alias("is_heading"), F.col("h_reason").alias("reason"), F.when(F.col("h_is_heading"), F.col("h_level")).cast("long").alias("level"),
        F.col("t_reject_reason").alias("reject_reason"), F.col("t_evidence").alias("evidence"), F.col("t_is_candidate").alias("is_candidate"),
        F.col("t_figure_internal").alias("figure_internal"), is_figure_caption(ws).alias("is_caption"), furniture.is_page_number(ws).alias("is_number"),
        (furniture.is_source_footer(ws) | furniture.is_generic_footer(ws)).alias("is_footer"), furniture.is_document_header(ws).alias("is_header"),
    )


def rule_cases(spark, sf_dir):
    return _ruled(case_texts(spark), "case_id")


def rules_over_texts(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select(F.format_string("d%d", "doc_id").alias("key"), "text")
    items = _table(spark, sf_dir, "benchmark").select(F.format_string("b%d", "item_id").alias("key"), "text")
    turns = _table(spark, sf_dir, "conversations").select(F.format_string("c%d-%d", "conv_id", "turn").alias("key"), "text")
    return _ruled(docs.union(items).union(turns).select("key", F.coalesce(normalize_text(F.col("text")), F.lit("")).alias("text")), "key")


def toc_blocks(spark, sf_dir):
    return _texts(spark, sf_dir).select(*_at(), "id", is_contents_table(plan.fallback_text()).alias("is_contents"))


def paragraph_blocks(spark, sf_dir):
    found = plan.analyzed(_raw(spark, sf_dir), ("paragraph",))
    return found.select(*_at(), "id", "normalized_text", F.get("source_text_block_ids", F.lit(0)).alias("text_id"))


def figure_blocks(spark, sf_dir):
    found = plan.analyzed(_raw(spark, sf_dir), ("figure",))
    return found.select(*_at(), "id", "caption", F.get("source_text_block_ids", F.lit(0)).alias("text_id"))


def table_reject_reasons(spark, sf_dir):
    found = table_features(_judged(spark, sf_dir), plan.fallback_text())
    return found.select(*_at(), "id", F.col("t_reject_reason").alias("reject_reason"), F.col("t_evidence").alias("evidence"), F.col("t_is_candidate").alias("is_candidate"))


def table_candidates(spark, sf_dir):
    found = plan.analyzed(_raw(spark, sf_dir), ("table",))
    cells = F.array_join(F.flatten("rows"), "|")
    return found.select(*_at(), "id", cells.alias("cells"), F.get("source_text_block_ids", F.lit(0)).alias("text_id"))


def figure_context_join(spark, sf_dir):
    rows = plan.in_context(_texts(spark, sf_dir)).where("is_body and t_is_candidate")
    return rows.select(*_at(), "id", F.col("t_figure_internal").alias("figure_internal"), F.size("figures").cast("long").alias("n_figures"), "suppressed")


def prose_features_documents(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select(F.format_string("d%d", "doc_id").alias("key"), "text")
    turns = _table(spark, sf_dir, "conversations").select(F.format_string("c%d-%d", "conv_id", "turn").alias("key"), "text")
    rows = docs.union(turns).select("key", match_text(F.col("text")).alias("ws"), lines(F.col("text")).alias("l")).withColumn("w", words(F.col("ws")))
    low = share(count(F.col("w"), starts_lower), F.size("w"))
    return rows.select("key", F.size("w").cast("long").alias("n_words"), F.size("l").cast("long").alias("n_lines"), F.round(low, 6).alias("lower_share"), any_mark(F.col("ws")).alias("has_marks"))


def page_block_order(spark, sf_dir):
    columns = ("document_path", "document_id", "page_number", "phase", "block_index", "sub_index", "id", "block_type")
    return plan.ordered(plan.analyzed(_raw(spark, sf_dir), columns=columns)).select(*_at(), *_long("position"), "block_type", "id")


def lineage_join(spark, sf_dir):
    found = plan.lineage(_raw(spark, sf_dir))
    name = F.regexp_extract("document_path", "/library/(.*)[.]pdf", 1).alias("document_id")
    return found.select(name, _at()[1], "id", "block_type", "text_id", "source_text")


def json_export(spark, sf_dir):
    blocks = plan.analyzed(_raw(spark, sf_dir))
    whole = F.struct(*plan.BLOCKS)
    return blocks.select(*_at(), "id", block_json(whole).alias("json")).select(
        "document_id", "page_number", "id", F.get_json_object("json", "$.block_type").alias("block_type"),
        F.get_json_object("json", "$.source.document_path").alias("path"), F.coalesce(F.get_json_object("json", "$.level").cast("long"), F.lit(0)).alias("level"),
        F.get_json_object("json", "$.is_page_furniture").alias("furniture"), F.size(F.expr("json_object_keys(json)")).cast("long").alias("n_keys"),
    )


def markdown_export(spark, sf_dir):
    pages = plan.pages(_raw(spark, sf_dir), ("text",))
    fields = F.struct("page_number", "has_native_text", "requires_ocr", "text_blocks")
    return pages.select(*_at(), F.array_join(page_lines(fields), "\n").alias("markdown"))


def block_type_rollup(spark, sf_dir):
    blocks = plan.analyzed(_raw(spark, sf_dir), columns=("document_id", "page_number", "block_type")).select(*_at(), "block_type")
    n = [F.grouping(c).cast("long").alias(f"all_{k}") for c, k in (("page_number", "pages"), ("block_type", "types"))]
    found = blocks.rollup("page_number", "block_type").agg(F.count("*").alias("n_blocks"), F.countDistinct("document_id").alias("n_documents"), *n)
    return found.fillna({"page_number": 0, "block_type": "all"})


def turns_as_blocks(spark, sf_dir):
    texts = plan.text_blocks(blocks_of_turns(_table(spark, sf_dir, "conversations")))
    return texts.select("document_id", "id", *_long("block_index"), "normalized_text")


def html_as_blocks(spark, sf_dir):
    texts = plan.text_blocks(blocks_of_html(_table(spark, sf_dir, "pages")))
    return texts.groupBy("document_id").agg(F.count("*").alias("n_blocks"), F.sum(F.length("normalized_text")).alias("n_chars"))


QUERIES = {
    f.__name__: f
    for f in (
        normalize_documents, match_text_lines, keywords_split, raw_blocks_scan, page_ocr_status, furniture_flags, furniture_summary,
        heading_predicate, heading_levels, heading_lines, toc_blocks, rule_cases, rules_over_texts, paragraph_blocks, figure_blocks, table_reject_reasons,
        table_candidates, figure_context_join, prose_features_documents, page_block_order, lineage_join, json_export, markdown_export,
        block_type_rollup, turns_as_blocks, html_as_blocks,
    )
}

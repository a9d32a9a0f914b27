"""The document plan: raw blocks to typed blocks, pages and documents.

Everything a rule looks up lies on one page, so the plan needs one exchange on
(document_path, page_number): page headings and figure captions are window aggregates
over it, counters are row numbers within it, and nesting groups by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import has, match_text, normalize_text, strip
from ..operators import furniture
from ..operators.figures import is_figure_caption
from ..operators.headings import with_headings
from ..operators.tables import suppression, table_features
from ..schema import FLAGS, METADATA_FIELDS, PAGE, PHASES

SOURCE = ("document_path", "page_number", "bbox", "extraction_method", "confidence")
KINDS = tuple(PHASES)
#: Columns of the blocks relation, in order.
BLOCKS = (
    "document_path", "document_id", "page_number", "phase", "block_index", "sub_index", "id", "source", "block_type", "text",
    "normalized_text", *FLAGS, "level", "caption", "rows", "image_path", "source_text_block_ids", "is_candidate", "latex", "variables",
)


def text_blocks(raw: DataFrame) -> DataFrame:
    """Native text blocks with ids, normalized text and furniture flags.

    Blocks without text are dropped; ids and block_index (from 1) count the kept ones, in
    the extractor's order; blocks that tie in it, or have none, follow by text and bbox.
    """
    order = F.row_number().over(Window.partitionBy(*PAGE).orderBy("raw_ordinal", "text", "bbox"))
    kept = raw.where(F.coalesce(strip(F.col("text")) != "", F.lit(False))).withColumn("block_index", order)
    kept = kept.withColumns(
        {
            "id": F.format_string("page-%d-text-%d", "page_number", "block_index"),
            "normalized_text": normalize_text(F.col("text")),
            "source": F.struct(*SOURCE),
        }
    )
    kept = kept.withColumn("ws", match_text(F.coalesce("normalized_text", "text")))
    return kept.withColumns(furniture.flags(F.col("ws"), F.col("bbox"), F.col("page_height")))


def fallback_text() -> Column:
    """The text that paragraph, figure and table rules read."""
    return F.coalesce(F.nullif("normalized_text", F.lit("")), F.col("text"))


def in_context(texts: DataFrame) -> DataFrame:
    """Text blocks with the rule features and their page's context.

    Adds the headings of the block, its heading and table features (h_, t_), `figures` (the
    page's captions, each with its bbox), `is_figure`, `is_body` (neither furniture nor equal
    to a heading of the page) and `is_table`, with `suppressed` where figure context decides.
    """
    page = Window.partitionBy(*PAGE)
    # a block with text has a normalized text, so the headings' features are the block's
    rows = table_features(with_headings(texts), fallback_text())
    body = ~F.col("is_page_furniture")
    rows = rows.withColumn("is_figure", body & is_figure_caption(F.col("t_ws")))
    texts_of = F.transform("own_headings", lambda h: match_text(F.coalesce(F.nullif(h["normalized_text"], F.lit("")), h["text"])))
    rows = rows.withColumn("heading_texts", texts_of).withColumns(
        {
            "headings": F.flatten(F.collect_list("heading_texts").over(page)),
            "figures": F.collect_list(F.when(F.col("is_figure"), F.struct("bbox"))).over(page),
        }
    )
    rows = rows.withColumn("is_body", body & ~F.array_contains("headings", F.col("t_ws")))
    candidate = F.col("is_body") & F.col("t_is_candidate")
    why = suppression(F.col("t_figure_internal"), F.col("bbox"), F.col("page_height"), F.col("figures"))
    return rows.withColumn("suppressed", F.when(candidate, why)).withColumn("is_table", candidate & F.col("suppressed").isNull())


_FIELDS = {"phase": "int", "sub_index": "int", "id": "string", "block_type": "string", "text": "string", "normalized_text": "string"}
_FIELDS |= dict.fromkeys(FLAGS, "boolean")
_FIELDS |= {"level": "int", "caption": "string", "rows": "array<array<string>>", "source_text_block_ids": "array<string>", "is_candidate": "boolean"}


def blocks_in_context(context: DataFrame, kinds: tuple[str, ...] = KINDS, columns: tuple[str, ...] = BLOCKS, **more: Column) -> DataFrame:
    """The blocks of some kinds that the rows of `in_context` stand for, with some columns.

    Of kinds and columns that are not asked for nothing is built. more: further columns,
    over those of the text block that a block comes from.
    """
    fields = {f: t for f, t in _FIELDS.items() if f in {*columns, "block_type", "sub_index"} or (f == "id" and "id" in columns)}

    def _entry(kind: str, **values: Column) -> Column:
        own = values | {"phase": F.lit(PHASES[kind]), "block_type": F.lit(kind)}
        return F.struct(*(own.get(f, F.lit(None)).cast(t).alias(f) for f, t in fields.items()))

    texts = {"text": F.col("text"), "normalized_text": F.col("normalized_text")}
    derived = texts | {"sub_index": F.lit(0), "source_text_block_ids": F.array("id")}
    made = {
        "text": lambda: F.array(_entry("text", id=F.col("id"), sub_index=F.lit(-1), **texts, **{f: F.col(f) for f in FLAGS})),
        "heading": lambda: F.transform(
            "own_headings",
            lambda h: _entry("heading", id=h["id"], sub_index=h["sub_index"], text=h["text"], normalized_text=h["normalized_text"], level=h["level"]),
        ),
        "paragraph": lambda: F.when(F.col("is_body"), F.array(_entry("paragraph", **derived))).otherwise(F.array()),
        "figure": lambda: F.when(F.col("is_figure"), F.array(_entry("figure", **derived, caption=F.col("t_ws"), is_candidate=F.lit(True)))).otherwise(F.array()),
        "table": lambda: F.when(
            F.col("is_table"), F.array(_entry("table", **derived, rows=F.transform("t_lines", lambda x: F.array(x)), is_candidate=F.lit(True)))
        ).otherwise(F.array()),
    }
    entries = F.concat(*(made[kind]() for kind in KINDS if kind in kinds))
    own = [c for c in ("document_id", "source") if c in columns]
    further = [value.alias(name) for name, value in more.items()]
    rows = context.select(*PAGE, "block_index", *own, *further, F.explode(entries).alias("b")).select(*PAGE, "block_index", *own, *more, "b.*")
    if "id" in columns:
        number = F.row_number().over(Window.partitionBy(*PAGE, "block_type").orderBy("block_index", "sub_index"))
        rows = rows.withColumn("id", F.coalesce("id", F.format_string("page-%d-%s-%d", "page_number", "block_type", number)))
    none = {"image_path": "string", "latex": "string", "variables": "array<string>"}
    return rows.select(*(F.lit(None).cast(none[c]).alias(c) if c in none else c for c in columns), *more)


def analyzed(raw: DataFrame, kinds: tuple[str, ...] = KINDS, columns: tuple[str, ...] = BLOCKS) -> DataFrame:
    """Blocks of `raw` (see `schema.RAW_BLOCKS`), typed, with (phase, block_index, sub_index)
    as the order within a page; all, or those of some kinds. One exchange, on the page."""
    if set(kinds) == {"text"}:  # text blocks need no page's context
        empty = F.array().cast("array<string>")
        rows = text_blocks(raw).withColumns({"own_headings": empty, "is_body": F.lit(False), "is_figure": F.lit(False), "is_table": F.lit(False)})
        return blocks_in_context(rows, kinds, columns)
    return blocks_in_context(in_context(text_blocks(raw)), kinds, columns)


def of_kind(blocks: DataFrame, kind: str) -> DataFrame:
    return blocks.where(F.col("block_type") == kind)


def ordered(blocks: DataFrame) -> DataFrame:
    """Blocks with `position`, their place in their page (from 1)."""
    order = Window.partitionBy(*PAGE).orderBy("phase", "block_index", "sub_index")
    return blocks.withColumn("position", F.row_number().over(order))


def page_status(raw: DataFrame) -> DataFrame:
    """Every page, with has_native_text and requires_ocr; pages without text stay."""
    kept = F.max(F.coalesce(strip(F.col("text")) != "", F.lit(False)))
    found = raw.groupBy(*PAGE).agg(
        F.first("document_id").alias("document_id"), F.first("page_width").alias("width"), F.first("page_height").alias("height"), kept.alias("has_native_text")
    )
    return found.withColumn("requires_ocr", ~F.col("has_native_text"))


def pages(raw: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """A row per page with its blocks (of some kinds) and text blocks as arrays in order."""
    fields = [c for c in BLOCKS if c not in ("document_path", "document_id", "page_number")]
    nested = analyzed(raw, kinds).groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.struct("phase", "block_index", "sub_index", F.struct(*fields).alias("block")))).alias("b"))
    blocks = F.transform("b", lambda x: x["block"])
    rows = page_status(raw).join(nested, [*PAGE], "left").withColumn("blocks", F.coalesce(blocks, F.array()))
    return rows.drop("b").withColumn("text_blocks", F.filter("blocks", lambda x: x["block_type"] == "text"))


def documents(raw: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """A row per document: id, source_path, metadata, pages in order."""
    page = F.struct("page_number", "width", "height", "has_native_text", "requires_ocr", "blocks", "text_blocks")
    found = pages(raw).groupBy("document_path").agg(F.first("document_id").alias("id"), F.sort_array(F.collect_list(page)).alias("pages"))
    if metadata is None:
        none = F.struct(*(F.lit(None).cast("string").alias(f) for f in METADATA_FIELDS), F.array().cast("array<string>").alias("keywords"))
        return found.select("id", F.col("document_path").alias("source_path"), none.alias("metadata"), "pages")
    return found.join(cleaned_metadata(metadata), "document_path", "left").select("id", F.col("document_path").alias("source_path"), "metadata", "pages")


def split_keywords(raw: Column) -> Column:
    """By commas if there are any, else by semicolons, else by white space; blanks drop."""
    mark = F.when(has(raw, ","), F.split(raw, ",")).when(has(raw, ";"), F.split(raw, ";")).otherwise(F.split(match_text(raw), " "))
    parts = F.array_remove(F.transform(mark, strip), "")
    return F.coalesce(parts, F.array().cast("array<string>"))


def cleaned_metadata(metadata: DataFrame) -> DataFrame:
    """(document_path, metadata): fields stripped, blank ones null, keywords split."""
    fields = [F.nullif(strip(F.col(f)), F.lit("")).alias(f) for f in METADATA_FIELDS]
    return metadata.select("document_path", F.struct(*fields, split_keywords(F.nullif(strip(F.col("keywords")), F.lit(""))).alias("keywords")).alias("metadata"))


DERIVED = ("paragraph", "figure", "table")


def lineage(raw: DataFrame) -> DataFrame:
    """Derived blocks of `raw` with the text blocks that they come from: document_path,
    page_number, id, block_type, text_id, source_text. A derived block is made in the row of
    its text block, so there is no join."""
    context = in_context(text_blocks(raw))
    return blocks_in_context(context, DERIVED, (*PAGE, "id", "block_type"), text_id=F.col("id"), source_text=F.col("normalized_text"))


def lineage_of_blocks(blocks: DataFrame) -> DataFrame:
    """The same from a relation of blocks that is at hand, by a join on page and id."""
    derived = blocks.where("source_text_block_ids is not null").select(*PAGE, "id", "block_type", F.explode("source_text_block_ids").alias("text_id"))
    texts = blocks.where("block_type = 'text'").select(*PAGE, F.col("id").alias("text_id"), F.col("normalized_text").alias("source_text"))
    return derived.join(texts, [*PAGE, "text_id"])


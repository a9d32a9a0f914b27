"""Markdown: a document's metadata, pages and text blocks."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import METADATA_FIELDS


def _plain(number: Column) -> Column:
    """A double as its shortest decimal form with at least one decimal."""
    return number.cast("string")


def _named(value: Column) -> Column:
    return F.coalesce(value, F.lit("None"))


def _truth(value: Column) -> Column:
    return F.when(value, "True").otherwise("False")


def bbox_text(box: Column) -> Column:
    inner = F.concat_ws(", ", *(_plain(box[c]) for c in ("x0", "y0", "x1", "y1")))
    return F.when(box.isNull(), "None").otherwise(F.concat(F.lit("("), inner, F.lit(")")))


def source_text(source: Column) -> Column:
    return F.concat(
        F.lit("Source: page "),
        _named(source["page_number"].cast("string")),
        F.lit(", bbox "),
        bbox_text(source["bbox"]),
        F.lit(", method "),
        _named(source["extraction_method"]),
        F.lit(", confidence "),
        _named(_plain(source["confidence"])),
    )


def metadata_lines(metadata: Column) -> Column:
    """A line per field that is there, keywords joined; `- none` if there is no field."""
    fields = [F.when(metadata[f] != "", F.concat(F.lit(f"- {f}: "), metadata[f])) for f in METADATA_FIELDS]
    words = F.when(F.size(metadata["keywords"]) > 0, F.concat(F.lit("- keywords: "), F.array_join(metadata["keywords"], ", ")))
    found = F.array_compact(F.array(*fields[:3], words, *fields[3:]))
    return F.when(F.size(found) == 0, F.array(F.lit("- none"))).otherwise(found)


def block_lines(block: Column) -> Column:
    """The lines of a text block, its blank last line included."""
    flags = [
        ("is_page_furniture", "Page furniture: yes"),
        ("is_page_header", "Header: yes"),
        ("is_page_footer", "Footer: yes"),
        ("is_page_number", "Page number: yes"),
    ]
    differs = block["normalized_text"].isNotNull() & (block["normalized_text"] != F.coalesce(block["text"], F.lit("")))
    notes = [F.when(block[f], F.lit(line)) for f, line in flags]
    notes.append(F.when(differs, F.lit("Normalized text available: yes")))
    head = F.array_compact(F.array(F.when(block["source"].isNotNull(), source_text(block["source"])), *notes))
    return F.concat(head, F.array(F.lit(""), F.coalesce(block["text"], F.lit("")), F.lit("")))


def page_lines(page: Column) -> Column:
    head = F.array(
        F.lit(""),
        F.concat(F.lit("## Page "), page["page_number"].cast("string")),
        F.lit(""),
        F.concat(F.lit("- has_native_text: "), _truth(page["has_native_text"])),
        F.concat(F.lit("- requires_ocr: "), _truth(page["requires_ocr"])),
        F.lit(""),
    )
    return F.concat(head, F.flatten(F.transform(page["text_blocks"], block_lines)))


def document_markdown(documents: DataFrame) -> DataFrame:
    """(source_path, markdown) per document."""
    title = F.coalesce(F.nullif(F.col("metadata.title"), F.lit("")), F.col("id"))
    head = F.array(F.concat(F.lit("# "), title), F.lit(""), F.concat(F.lit("Source path: "), "source_path"), F.lit(""), F.lit("## Metadata"), F.lit(""))
    lines = F.concat(head, metadata_lines(F.col("metadata")), F.flatten(F.transform("pages", page_lines)))
    text = F.concat(F.regexp_replace(F.array_join(lines, "\n"), r"\s+\z", ""), F.lit("\n"))
    return documents.select("source_path", text.alias("markdown"))


def export_markdown(documents: DataFrame, output: str) -> None:
    """One document as a Markdown file on the driver."""
    rows = document_markdown(documents).take(2)
    if len(rows) != 1:
        raise ValueError("a single document is needed")
    target = Path(output)
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(rows[0]["markdown"], encoding="utf-8")

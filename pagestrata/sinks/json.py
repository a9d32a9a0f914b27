"""JSON: keys in declaration order, nulls written, per block type its own keys."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import FLAGS

_BASE = ("id", "source", "block_type", "text", "normalized_text")
#: Keys of each type after the common ones.
_OWN = {
    "text": FLAGS,
    "paragraph": ("source_text_block_ids",),
    "heading": ("level",),
    "table": ("caption", "rows", "source_text_block_ids", "is_candidate"),
    "formula": ("latex", "variables"),
    "figure": ("caption", "image_path", "source_text_block_ids", "is_candidate"),
}
_KEEP = {"ignoreNullFields": "false"}


def block_json(block: Column) -> Column:
    """A block of the blocks relation (a struct or its columns) as a JSON object."""
    out = None
    for kind, own in _OWN.items():
        made = F.to_json(F.struct(*(block[k].alias(k) for k in (*_BASE, *own))), _KEEP)
        out = F.when(block["block_type"] == kind, made) if out is None else out.when(block["block_type"] == kind, made)
    return out


def page_json(page: Column) -> Column:
    """A page of `plans.document.documents` as a JSON object."""

    def listed(blocks: Column) -> Column:
        return F.concat(F.lit("["), F.array_join(F.transform(blocks, block_json), ","), F.lit("]"))

    head = F.to_json(F.struct(*(page[k].alias(k) for k in ("page_number", "width", "height", "has_native_text", "requires_ocr"))), _KEEP)
    return F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"blocks":'), listed(page["blocks"]), F.lit(',"text_blocks":'), listed(page["text_blocks"]), F.lit("}"))


def document_json(documents: DataFrame) -> DataFrame:
    """(source_path, json) per document."""
    head = F.to_json(F.struct("id", "source_path", "metadata"), _KEEP)
    pages = F.array_join(F.transform("pages", page_json), ",")
    text = F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"pages":['), pages, F.lit("]}"))
    return documents.select("source_path", text.alias("json"))


def write_json(documents: DataFrame, folder: str) -> None:
    """JSON lines, a document each, written by the executors."""
    document_json(documents).select("json").write.mode("overwrite").text(folder)


def export_document(documents: DataFrame, output: str, indent: int | None = 2) -> None:
    """One document as a file on the driver: ASCII with escapes, indented; makes folders."""
    rows = document_json(documents).take(2)
    if len(rows) != 1:
        raise ValueError("a single document is needed")
    target = Path(output)
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(json.dumps(json.loads(rows[0]["json"]), indent=indent), encoding="utf-8")

"""The PDF adapter: file bytes to raw blocks. Needs PyMuPDF where the executors run."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..schema import METADATA_FIELDS, RAW_BLOCKS


def _files(spark: SparkSession, path: str) -> DataFrame:
    """Files with the suffix .pdf in any case; one row each, so a file is a task's unit."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load(path).select("path", "content")


def _opened(content: bytes):
    try:
        import fitz
    except ImportError as missing:
        raise RuntimeError("reading PDF files needs PyMuPDF on the executors") from missing
    return fitz.open(stream=content, filetype="pdf")


def _stem(path: str) -> str:
    return path.rsplit("/", 1)[-1].rsplit(".", 1)[0]


def _local(path: str) -> str:
    return path.removeprefix("file:")


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = RAW_BLOCKS.names
    for files in batches:
        for path, content in zip(files["path"], files["content"], strict=True):
            rows = []
            with _opened(content) as document:
                for number, page in enumerate(document, start=1):
                    head = (_local(path), _stem(path), number, float(page.rect.width), float(page.rect.height))
                    found = [b for b in page.get_text("blocks") if len(b) >= 5]
                    for ordinal, (x0, y0, x1, y1, text, *_) in enumerate(found):
                        rows.append((*head, ordinal, {"x0": x0, "y0": y0, "x1": x1, "y1": y1}, text, "pymupdf", 1.0))
                    if not found:  # a page without text still is a page
                        rows.append((*head, 0, None, None, "pymupdf", None))
            yield pd.DataFrame(rows, columns=names)


def _metadata(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    fields = [*METADATA_FIELDS, "keywords"]
    for files in batches:
        rows = []
        for path, content in zip(files["path"], files["content"], strict=True):
            with _opened(content) as document:
                known = document.metadata or {}
                rows.append((_local(path), *(v if isinstance(v := known.get(f), str) else None for f in fields)))
        yield pd.DataFrame(rows, columns=["document_path", *fields])


def read_pdfs(spark: SparkSession, path: str) -> DataFrame:
    return _files(spark, path).mapInPandas(_blocks, RAW_BLOCKS)


def metadata_of_pdfs(spark: SparkSession, path: str) -> DataFrame:
    fields = ", ".join(f"{f} string" for f in ("document_path", *METADATA_FIELDS, "keywords"))
    return _files(spark, path).mapInPandas(_metadata, fields)

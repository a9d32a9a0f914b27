"""Schemas of the block model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BBOX = T.StructType([T.StructField(c, T.DoubleType()) for c in ("x0", "y0", "x1", "y1")])

#: Scan output: a row per native text block.
RAW_BLOCKS = T.StructType(
    [
        T.StructField("document_path", T.StringType(), False),
        T.StructField("document_id", T.StringType()),
        T.StructField("page_number", T.IntegerType()),
        T.StructField("page_width", T.DoubleType()),
        T.StructField("page_height", T.DoubleType()),
        T.StructField("raw_ordinal", T.IntegerType()),
        T.StructField("bbox", BBOX),
        T.StructField("text", T.StringType()),
        T.StructField("extraction_method", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
    ]
)

METADATA_FIELDS = ("title", "author", "subject", "producer", "creator")
FLAGS = ("is_page_header", "is_page_footer", "is_page_number", "is_page_furniture")
#: A page: rows never cross it, so it is the unit of every window and exchange.
PAGE = ("document_path", "page_number")
#: Phases of a page's block order.
PHASES = {"text": 0, "heading": 0, "paragraph": 1, "figure": 2, "table": 3}


def violations() -> Column:
    """The broken constraints of a raw block, as names; empty when it is sound."""
    box = F.col("bbox")
    rules = {
        "bbox_x": box["x1"] < box["x0"],
        "bbox_y": box["y1"] < box["y0"],
        "confidence": (F.col("confidence") < 0) | (F.col("confidence") > 1),
        "page_number": F.col("page_number") < 1,
    }
    return F.array_compact(F.array(*(F.when(F.coalesce(broken, F.lit(False)), F.lit(name)) for name, broken in rules.items())))

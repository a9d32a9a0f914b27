"""SQL access: the block model as temporary views."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .document import analyzed, lineage, ordered, page_status


def register_views(raw: DataFrame, prefix: str = "") -> None:
    """Views raw_blocks, blocks (with position), page_status and lineage over `raw`."""
    blocks = ordered(analyzed(raw))
    for name, view in (("raw_blocks", raw), ("blocks", blocks), ("page_status", page_status(raw)), ("lineage", lineage(raw))):
        view.createOrReplaceTempView(f"{prefix}{name}")

"""Figure candidates from captions."""

from __future__ import annotations

from pyspark.sql import Column

from ..functions.text import whole

#: Fixed value.
CAPTION = r"(?i)FIGURE (?:\p{Nd}+|[A-Z]-\p{Nd}+)\. \S.+"


def is_figure_caption(ws: Column) -> Column:
    return whole(ws, CAPTION)

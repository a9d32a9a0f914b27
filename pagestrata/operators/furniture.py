"""Page furniture: headers, footers and page numbers of a text block."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import found, has, whole

#: Fixed values.
ROMAN_PAGES = ("i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x", "xi", "xii")
GENERIC_FOOTER = r"(?i)\| ?Page \p{Nd}+\b"
SOURCE_URL = r"(?i)source: ?https?://"
DOCUMENT_HEADER = r"(?i)MIL-STD-[A-Z0-9]+(?: w/CHANGE \p{Nd}+)?|FTIAS Manual"
SECTION = r"(?i)\p{Nd}+(?:\.\p{Nd}+)*\. \S.+|FOREWORD|CONTENTS|SUMMARY OF CHANGE 1 MODIFICATIONS"
TOP, BOTTOM = 0.12, 0.88


def is_page_number(ws: Column) -> Column:
    return whole(ws, r"\p{Nd}+") | F.lower(ws).isin(*ROMAN_PAGES)


def is_source_footer(ws: Column) -> Column:
    low = F.lower(ws)
    notice = has(low, "check the source to verify") & has(low, "current version")
    return found(ws, SOURCE_URL) | notice | (has(low, "source:") & has(low, "verify"))


def is_document_header(ws: Column) -> Column:
    return whole(ws, DOCUMENT_HEADER) & ~whole(ws, SECTION)


def is_generic_footer(ws: Column) -> Column:
    return (F.length(ws) <= 140) & found(ws, GENERIC_FOOTER)


def is_near_top(box: Column, height: Column) -> Column:
    return F.coalesce((height > 0) & (box["y0"] <= height * TOP), F.lit(False))


def is_near_bottom(box: Column, height: Column) -> Column:
    return F.coalesce((height > 0) & (box["y1"] >= height * BOTTOM), F.lit(False))


def flags(ws: Column, box: Column, height: Column) -> dict[str, Column]:
    """The four flags of a block, from its collapsed text and its place on the page."""
    number, top = is_page_number(ws), is_near_top(box, height)
    footer, header = is_source_footer(ws) | is_generic_footer(ws), top & is_document_header(ws)
    return {
        "is_page_header": (number & top) | header,
        "is_page_footer": (number & is_near_bottom(box, height)) | footer,
        "is_page_number": number,
        "is_page_furniture": number | footer | header,
    }

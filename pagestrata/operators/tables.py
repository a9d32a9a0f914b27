"""Table candidates: evidence, ordered rejections, and suppression near figures.

`table_features(df, text)` needs heading features under `h_` and adds, under a prefix,
`is_candidate`, `reject_reason`, `evidence`, `figure_internal` and `strong`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.staged import staged
from ..functions.text import WS, any_mark, chosen, count, found, has, lines, match_text, share, starts_lower, whole, words

#: Fixed values.
HEADER_TERMS = (
    "category", "criteria", "description", "entity", "key links", "level", "mishap result criteria", "probability", "purpose",
    "severity", "specific individual item", "fleet or inventory", "why it matters",
)
SEVERITY_TERMS = ("catastrophic", "critical", "frequent", "marginal", "negligible", "probable", "occasional", "remote", "improbable")
HEADING_LINES = ("probability levels", "severity categories")
NODES = ("decision", "end", "input", "output", "start")
FORM_LABELS = ("approved", "by", "causes", "date", "description", "hazard", "id", "log", "prepared", "report", "title", "tracking")
SECTION_WORDS = ("category", "description", "details", "level", "probability", "purpose", "severity", "specified")
FIGURE_PHRASES = (
    "cm/drawing control", "contribution to system risk", "engineering design process", "hazard tracking log", "operator training",
    "safety-significant software", "system and software system", "system risk", "typical safety activities",
)
TITLE = r"(?i)TABLE (?:\p{Nd}+|[A-Z]-?[IVXLCDM]+|[IVXLCDM]+)\.?(?: \S.+)?"
ROMAN_LABEL = r"(?:[IVXLCDM]+|[A-Z]-[IVXLCDM]+)\. \S.+"
LETTERED = rf"(?i)\A[a-z]\.[{WS}]+\S.+\z"
PAREN = r"\(\p{Nd}+\)"
DEFINITION = r"\A\p{Nd}+(?:\.\p{Nd}+){2,} ([^.]{1,80})\. (\S.+)\z"
SECTION_PROSE = r"\A\p{Nd}+(?:\.\p{Nd}+)+ \S[^.]{1,80}\. \S.+\z"
NUMBERED_PROSE = r"(?i)\A\p{Nd}+\. (?:This|These|The|DoD|Comments|Since|When|If|A|An)\b"
REFERENCE = r"(?i)\bTables? [A-Z0-9][A-Z0-9.-]*\b"
FIGURE_LOOSE = r"(?i)\AFigure (?:\p{Nd}+|[A-Z]-?\p{Nd}+)[.:] \S.+\z"
FIGURE_REFERENCE = r"(?i)\bFigures? (?:\p{Nd}+|[A-Z]-?\p{Nd}+)[A-Z0-9.-]*\b"
PROCESS = rf"(?i)\A(?:Element|Process Step|Step)[{WS}]+\p{{Nd}}+:[{WS}]*\z"
TOC_END = r"(?i)\.{5,} ?(?:[ivxlcdm]+|\p{Nd}+)\z"
COLUMNS = r"\S(?: {2,}|\t+)\S"


def _number(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [t.cast("int") for t in tests])


def _line_words(line: Column) -> Column:
    return words(match_text(line))


def _short_title(line: Column) -> Column:
    parts = _line_words(F.regexp_replace(line, ":+\\z", ""))
    return (F.size(parts) >= 1) & (F.size(parts) <= 6) & F.forall(parts, lambda w: F.length(w) <= 18)


def is_table_caption(ws: Column) -> Column:
    return whole(ws, TITLE) | whole(ws, ROMAN_LABEL)


def _base(text: Column):
    def stage(c) -> dict[str, Column]:
        return {"lines": lines(text), "ws": match_text(text)}

    return stage


def _counts(c) -> dict[str, Column]:
    ws = c("ws")
    return {
        "low": F.lower(ws),
        "n": F.length(ws),
        "words": words(ws),
        "plain": F.transform(c("lines"), lambda x: F.lower(match_text(x))),
        "n_lines": F.size(c("lines")),
        "n_columns": count(c("lines"), lambda x: found(x, COLUMNS)),
        "caption": is_table_caption(ws),
    }


def _signs(c) -> dict[str, Column]:
    low, plain, n_lines = c("low"), c("plain"), c("n_lines")
    second = match_text(F.get(c("lines"), F.lit(1)))
    value = whole(second, r"\p{Nd}+") | F.lower(second).isin("i", "ii", "iii", "iv") | whole(second, r"[\p{L}&&\p{IsUppercase}]")
    label = F.coalesce((n_lines >= 2) & F.get(plain, F.lit(0)).isin(*SEVERITY_TERMS) & value, F.lit(False))
    later = F.slice(c("lines"), 3, F.greatest(n_lines, F.lit(1)))
    return {
        "n_words": F.size(c("words")),
        "lower_share": share(count(c("words"), starts_lower), F.size(c("words"))),
        "marks": any_mark(c("ws")),
        "terms": _number([has(low, t) for t in HEADER_TERMS]) >= 2,
        "vertical": n_lines.between(3, 8) & (F.size(F.array_intersect(plain, F.array(*map(F.lit, HEADER_TERMS)))) >= 3),
        "row": label & ((n_lines == 2) | F.exists(later, lambda x: F.size(_line_words(x)) >= 4)),
        "titles": F.forall(c("lines"), _short_title),
        "n_parens": count(c("lines"), lambda x: whole(x, PAREN)),
    }


def _evidence(c) -> dict[str, Column]:
    n_lines = c("n_lines")
    headers = F.when(n_lines == 1, c("low").isin(*HEADING_LINES)).otherwise((n_lines <= 12) & (c("n") <= 240) & (c("terms") | c("vertical")))
    continued = F.exists(F.slice(c("lines"), 2, F.greatest(n_lines, F.lit(1))), starts_lower)
    wrapped = (n_lines >= 3) & (c("n_words") >= 18) & (c("lower_share") >= 0.45) & continued
    short = count(c("lines"), lambda x: F.size(_line_words(x)).between(2, 8))
    rows = ~wrapped & (n_lines >= 3) & (short >= 3)
    return {
        "headers": (c("ws") != "") & headers,
        "structured": (c("n_columns") >= 2) | c("vertical") | c("row"),
        "layout": (n_lines >= 2) & ((c("n_columns") >= 2) | c("row") | rows),
        "cluster": n_lines.between(2, 4) & F.forall(c("plain"), lambda x: x.isin(*NODES)),
        "cluster_in_figure": n_lines.between(2, 4) & F.forall(c("plain"), lambda x: x.isin(*NODES, "process")),
    }


def _kinds(c) -> dict[str, Column]:
    ws, n_lines, free = c("ws"), c("n_lines"), ~c("caption") & ~c("structured")
    term, body = words(F.regexp_extract(ws, DEFINITION, 1)), F.regexp_extract(ws, DEFINITION, 2)
    body_words = words(body)
    labels = F.flatten(F.transform(c("lines"), lambda x: F.regexp_extract_all(F.lower(x), F.lit("[a-z]+"), F.lit(0))))
    first = F.get(c("lines"), F.lit(0))
    average = share(F.aggregate(F.transform(c("lines"), F.length), F.lit(0), lambda a, b: a + b).cast("double"), n_lines)
    prose = (
        (found(ws, NUMBERED_PROSE) & (c("n_words") >= 12))
        | ((c("n_words") >= 24) & (c("lower_share") >= 0.45) & c("marks"))
        | ((c("n_words") >= 18) & (average >= 65) & (c("lower_share") >= 0.4))
    )
    return {
        "definition": free
        & found(ws, DEFINITION)
        & F.size(term).between(1, 8)
        & (F.size(body_words) >= 5)
        & (share(count(body_words, starts_lower), F.size(body_words)) >= 0.35)
        & any_mark(body),
        "reference": free & found(ws, REFERENCE),
        "figure": ~c("caption") & (found(ws, FIGURE_LOOSE) | (found(ws, FIGURE_REFERENCE) & ~c("structured"))),
        "process": free & F.when(found(first, PROCESS), n_lines.between(2, 4) & c("titles")).otherwise(c("cluster")),
        "form": free
        & n_lines.between(3, 8)
        & c("titles")
        & (F.size(labels) > 0)
        & (share(count(labels, lambda w: w.isin(*FORM_LABELS)), F.size(labels)) >= 0.75),
        "section": free
        & found(ws, SECTION_PROSE)
        & (_number([has(c("low"), w) for w in SECTION_WORDS]) > 0)
        & (c("lower_share") >= 0.35)
        & c("marks"),
        "list_item": found(first, LETTERED) | (c("n_parens") >= 2) | ((c("n_parens") == 1) & (n_lines <= 3)),
        "prose": (ws != "") & ~c("caption") & ~c("headers") & ~c("row") & prose,
        "strong": c("caption") | c("headers") | (c("n_columns") >= 2) | c("row"),
    }


def _verdict(c) -> dict[str, Column]:
    ws, heading = c("ws"), F.col("h_is_heading")
    rejected = chosen(
        [
            ("empty", ws == ""),
            ("dot_leader", found(ws, TOC_END)),
            ("link", has(ws, "http://") | has(ws, "https://")),
            ("source", F.startswith(c("low"), F.lit("source:"))),
            ("", c("caption")),
            ("definition", c("definition")),
            ("table_reference", c("reference")),
            ("figure_text", c("figure")),
            ("process_label", c("process")),
            ("form_labels", c("form")),
            ("section_prose", c("section")),
            ("list_item", c("list_item")),
            ("heading", heading),
            ("long_prose", c("prose")),
        ],
        "",
    )
    compact = c("n_lines").between(2, 8) & (c("n_words") <= 36) & F.forall(c("lines"), lambda x: F.length(x) <= 70)
    firsts = F.transform(c("plain"), lambda x: F.get(F.split(x, " "), F.lit(0)))
    repeated = (c("n_lines") >= 3) & F.exists(firsts, lambda x: count(firsts, lambda y: x == y) >= 3)
    phrase = _number([has(c("low"), p) for p in FIGURE_PHRASES]) > 0
    bullets = F.exists(c("lines"), lambda x: found(x, "\\A[-*\u2022]"))
    internal = F.when(c("process") | c("form"), True).when(phrase | bullets, compact).otherwise(c("cluster_in_figure") | repeated)
    return {
        "reject_reason": F.nullif(rejected, F.lit("")),
        "evidence": chosen([("caption", c("caption")), ("header_terms", c("headers")), ("line_structure", c("layout"))]),
        "figure_internal": (ws != "") & ~c("strong") & internal,
    }


def table_features(df: DataFrame, text: Column, prefix: str = "t_") -> DataFrame:
    rows = staged(df, _base(text), _counts, _signs, _evidence, _kinds, _verdict, prefix=prefix)
    reason, evidence = F.col(f"{prefix}reject_reason"), F.col(f"{prefix}evidence")
    return rows.withColumn(f"{prefix}is_candidate", reason.isNull() & evidence.isNotNull())


def is_near_figure(box: Column, height: Column, figures: Column) -> Column:
    """Whether a block lies in the region of a caption: an interval join within the page.

    `figures`: array of the page's captions with a bbox each (null if unknown).
    """
    high = F.coalesce(height, F.lit(0.0))
    window = F.greatest(high * 0.45, F.lit(180.0))

    def near(figure: Column) -> Column:
        c = figure["bbox"]
        gap = F.least(F.abs(box["y1"] - c["y0"]), F.abs(c["y1"] - box["y0"]))
        beside = (box["x0"] <= c["x1"]) & (c["x0"] <= box["x1"])
        below = (c["y0"] >= height * 0.6) & (box["y1"] <= c["y0"]) & (gap <= window)
        above = (c["y1"] <= height * 0.4) & (c["y1"] <= box["y0"]) & (gap <= window)
        close = gap <= F.least(window, F.lit(120.0))
        return F.coalesce(beside & (F.coalesce(below, F.lit(False)) | F.coalesce(above, F.lit(False)) | close), F.lit(False))

    return F.exists(figures, near)


def suppression(internal: Column, box: Column, height: Column, figures: Column) -> Column:
    """Why figure context keeps a candidate from being a table; null if it doesn't."""
    placed = box.isNotNull() & F.exists(figures, lambda f: f["bbox"].isNotNull())
    return F.when((F.size(figures) > 0) & internal, F.when(is_near_figure(box, height, figures), "near_caption").when(~placed, "no_geometry"))

"""Heading rules: ordered decision lists over staged features of a text.

`heading_features(df, text)` adds, under a prefix, the collapsed text `ws`, `level`,
`is_heading`, `reason` (the rule that decided) and the rules that other operators use.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.staged import bound, nested, staged, without
from ..functions.text import LINE_END, count, found, has, lines, match_text, whole, words

#: Fixed values.
FRONT_MATTER = ("ABSTRACT", "EXECUTIVE SUMMARY", "CONTENTS")
SHORT_TITLES = ("BACKEND", "DATABASE", "DOCKER", "FRONTEND", "LIMITATIONS", "LOGS", "MIGRATIONS", "OVERVIEW", "PREREQUISITES")
KNOWN_TITLES = ("APPLICABLE DOCUMENTS", "DEFINITIONS", "DETAILED REQUIREMENTS", "GENERAL REQUIREMENTS", "NOTES", "SCOPE")
STARTERS = ("A", "AN", "COMMENTS", "DOD", "IF", "SINCE", "THE", "THESE", "THIS", "WHEN")
STOP_WORDS = ("a", "an", "and", "are", "as", "be", "by", "for", "from", "in", "is", "of", "on", "or", "that", "the", "this", "to", "with")
CHAPTER = r"(?i)CHAPTER \p{Nd}+ - \S.+"
ANNEX = r"(?i)ANNEX [A-Z] - \S.+"
TASK = r"(?i)TASK \p{Nd}+(?: \S.+)?"
TASK_SECTION = r"(?i)TASK SECTION \p{Nd}+ - \S.+"
APPENDIX = r"(?i)APPENDIX [A-Z] \S.+"
SINGLE = r"\A(\p{Nd}+)\. \S.+\z"
NESTED = r"\A(\p{Nd}+\.\p{Nd}+(?:\.\p{Nd}+)*) \S.+\z"
ANNEX_SECTION = r"[A-Z]\.\p{Nd}+(?:\.\p{Nd}+)* \S.+"
DATED_FOOTER = (
    r"(?i)\| ?Page \p{Nd}+ (?:Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday), (?:January|February|March|April|May|June"
    r"|July|August|September|October|November|December) \p{Nd}{1,2}, \p{Nd}{4}"
)
TOC_END = r"(?i)\.{5,} ?(?:[ivxlcdm]+|\p{Nd}+)\z"
PAGE_END = r"(?i) (?:[ivxlcdm]+|\p{Nd}+)\z"


def mostly_upper(text: Column) -> Column:
    """At least three quarters of the letters are upper case; false without letters."""
    letters = F.regexp_replace(text, r"[^\p{L}]", "")
    upper = F.length(F.regexp_replace(letters, r"\P{IsUppercase}", ""))
    letters = F.length(letters)
    return (letters > 0) & (upper * 4 >= letters * 3)


def is_contents_table(text: Column) -> Column:
    """A block that reads like a table of contents: three of six signs."""
    upper = F.upper(match_text(text))
    each = F.transform(lines(text), match_text)
    signs = [
        has(upper, "CONTENTS"),
        has(upper, "PARAGRAPH"),
        has(upper, "PAGE"),
        has(text, "....."),
        count(each, lambda line: found(line, PAGE_END)) >= 3,
        count(each, lambda line: has(line, ".....") & found(line, TOC_END)) >= 2,
    ]
    return sum((s.cast("int") for s in signs[1:]), signs[0].cast("int")) >= 3


def _collapsed(text: Column):
    return lambda c: {"ws": match_text(text)}


def _shape(c) -> dict[str, Column]:
    ws = c("ws")
    return {
        "upper": F.upper(ws),
        "n": F.length(ws),
        "number": F.coalesce(F.nullif(F.regexp_extract(ws, SINGLE, 1), F.lit("")), F.nullif(F.regexp_extract(ws, NESTED, 1), F.lit(""))),
        "chapter": whole(ws, CHAPTER) | whole(ws, ANNEX),
        "task": whole(ws, TASK) | whole(ws, TASK_SECTION) | whole(ws, APPENDIX),
        "section": whole(ws, ANNEX_SECTION),
        "toc_entry": has(ws, ".....") & found(ws, TOC_END),
        "ends": found(ws, r"[.!?]\z"),
    }


def _title(c) -> dict[str, Column]:
    number, ws = c("number"), c("ws")
    start = F.length(number) + F.when(has(number, "."), 1).otherwise(2)
    appendix_for = whole(ws, r"Appendix [A-Z] for \S.+")
    see = F.startswith(c("upper"), F.lit("SEE APPENDIX ")) | F.startswith(c("upper"), F.lit("REFER TO APPENDIX "))
    named = (whole(ws, APPENDIX) & mostly_upper(ws)) | whole(ws, r"(?i)APPENDIX [A-Z] - \S.+")
    return {
        "title": F.when(start < c("n"), F.trim(F.substring(ws, start + 1, c("n")))),
        "single": number.isNotNull() & ~has(number, "."),
        "hundreds": found(number, r"\A0*[1-9]\p{Nd}{2,}(?:\.|\z)"),
        "front": c("upper").isin(*FRONT_MATTER),
        "listed": c("upper").isin(*FRONT_MATTER, *SHORT_TITLES),
        "appendix_ref": (F.size(words(ws)) >= 3) & ~named & (see | appendix_for),
    }


def _body(c) -> dict[str, Column]:
    title = c("title")
    bare = F.regexp_replace(title, r"[.:]+\z", "")
    parts, all_words = words(bare), words(title)
    short = (
        (F.size(parts) >= 1)
        & (F.size(parts) <= 6)
        & ~found(title, r"\.\z")
        & F.forall(parts, lambda w: found(w, r"\A\p{IsUppercase}") | (found(w, r"\p{IsUppercase}") & ~found(w, r"\p{IsLowercase}")))
    )
    stops = count(all_words, lambda w: F.lower(w).isin(*STOP_WORDS))
    first = F.upper(F.regexp_extract(title, r"\A[A-Za-z]+", 0))
    prose = first.isin(*STARTERS) | ((F.size(all_words) >= 10) & (stops >= 3)) | ((F.length(title) > 70) & (stops >= 2))
    named = F.upper(bare).isin(*KNOWN_TITLES) | mostly_upper(title) | short
    return {
        "numbered_body": F.coalesce(c("single") & title.isNotNull() & ((title == "") | (~named & prose)), F.lit(False)),
        "sentence": c("ends") & ~(c("number").isNotNull() & c("hundreds")) & ~c("chapter") & ~c("task") & ~c("front"),
    }


def _verdict(c) -> dict[str, Column]:
    ws, title = c("ws"), c("title")
    refused = F.when(c("listed") | (c("task") & ~c("appendix_ref")), F.lit(None).cast("string"))
    for name, test in (
        ("bullet", found(ws, r"\A[•*-]")),
        ("short", c("n") < 3),
        ("dots", has(ws, ".....")),
        ("link", found(ws, r"(?i)https?://") | has(ws, "@")),
        ("dated_footer", has(ws, "| Page ") & found(ws, DATED_FOOTER)),
        ("document_header", whole(ws, r"(?i)MIL-STD-\p{Nd}+[A-Z]?")),
        ("digits", whole(ws, r"\p{Nd}+")),
        ("roman", whole(ws, r"(?i)[IVXLCDM]+")),
        ("acronym", whole(ws, r"[A-Z][A-Z0-9-]{1,7}")),
        ("long", (c("n") > 120) & ~c("chapter") & ~c("task")),
        ("sentence", c("sentence")),
    ):
        refused = refused.when(test, F.lit(name))
    inner_stop = has(F.regexp_replace(title, r"\.+\z", ""), ". ")
    ends = found(title, r"[.!?]\z")
    numbered = (
        title.isNotNull()
        & (title != "")
        & (F.length(title) <= 100)
        & ~inner_stop
        & (~found(title, r"\.\z") | c("hundreds"))
        & (~ends | (c("hundreds") & (F.length(title) <= 80)))
    )
    return {"refused": refused, "numbered": F.coalesce(numbered, F.lit(False))}


def _decision(c) -> dict[str, Column]:
    reason = (
        F.when(c("ws") == "", "no:empty")
        .when(c("toc_entry"), "no:toc_entry")
        .when(c("numbered_body"), "no:numbered_body")
        .when(c("appendix_ref"), "no:appendix_reference")
        .when(c("refused").isNotNull(), F.concat(F.lit("no:"), c("refused")))
        .when(c("listed"), "yes:listed_title")
        .when(c("chapter"), "yes:chapter_or_annex")
        .when(c("task"), "yes:task_or_appendix")
        .when(c("n") > 120, "no:long")
        .when(c("number").isNotNull(), F.when(c("numbered"), "yes:numbered").otherwise("no:numbered"))
        .when(c("section"), F.when(c("sentence"), "no:sentence").otherwise("yes:annex_section"))
        .otherwise("no:plain")
    )
    dots = F.length(c("number")) - F.length(F.replace(c("number"), F.lit("."), F.lit("")))
    level = F.when(c("front") | c("chapter") | c("task"), 1).when(c("number").isNotNull(), dots + 1).otherwise(2)
    return {"reason": reason, "level": level.cast("int")}


_STAGES = (_shape, _title, _body, _verdict, _decision)


def heading_features(df: DataFrame, text: Column, prefix: str = "h_") -> DataFrame:
    found_ = staged(df, _collapsed(text), *_STAGES, prefix=prefix)
    return found_.withColumn(f"{prefix}is_heading", F.startswith(f"{prefix}reason", F.lit("yes:")))


def heading_id(block_id: Column) -> Column:
    """The block's id with its first -text- turned into -heading-, or with -heading added."""
    at = F.instr(block_id, "-text-")
    swapped = F.concat(F.substring(block_id, F.lit(1), at - 1), F.lit("-heading-"), F.substring(block_id, at + 6, F.length(block_id)))
    return F.when(at > 0, swapped).otherwise(F.concat(block_id, F.lit("-heading")))


def with_headings(texts: DataFrame) -> DataFrame:
    """Text blocks with their heading features (h_) and `own_headings`: array of (sub_index,
    id, text, normalized_text, level, reason, ws).

    The whole block comes first (sub_index 0), then its lines, numbered as they are emitted.
    Of equal headings of a block (case aside) the first stays. A block that reads like a
    table of contents lends only CONTENTS, unless it is a heading as a whole. Furniture has
    none. All of it is found within the row; the one line of a block of a single line is the
    block, so lines are judged where there are two or more.
    """
    detected = F.coalesce("normalized_text", "text")
    rows = heading_features(texts, detected)
    free = ~F.col("is_page_furniture")
    pieces = F.when(free, F.split(detected, LINE_END))
    rows = rows.withColumn("pieces", F.when(F.size(pieces) > 1, pieces)).withColumn("contents", F.col("pieces").isNotNull() & is_contents_table(detected))

    def judged(line: Column, k: Column) -> Column:
        def found(c) -> Column:
            kept = F.startswith(c("reason"), F.lit("yes:")) & (~F.col("contents") | (c("upper") == "CONTENTS"))
            return F.struct((k + 1).alias("at"), c("ws").alias("ws"), c("level").alias("level"), c("reason").alias("reason"), kept.alias("kept"))

        return nested([_collapsed(line), *_STAGES], found)

    whole_block = F.struct(F.lit(0).alias("at"), F.col("h_ws").alias("ws"), F.col("h_level").alias("level"), F.col("h_reason").alias("reason"), F.col("h_is_heading").alias("kept"))
    none = F.array().cast("array<struct<at: int, ws: string, level: int, reason: string, kept: boolean>>")
    each = F.concat(F.when(free, F.array(whole_block)).otherwise(none), F.coalesce(F.transform("pieces", judged), none))

    def distinct(found: Column) -> Column:
        return F.filter(found, lambda x, k: ~F.exists(F.slice(found, 1, k), lambda y: F.lower(y["ws"]) == F.lower(x["ws"])))

    def numbered(found: Column) -> Column:
        whole_first = F.coalesce(F.get(found, F.lit(0))["at"] == 0, F.lit(False))

        def named(x: Column, k: Column) -> Column:
            own, number = x["at"] == 0, F.when(whole_first, k).otherwise(k + 1)
            return F.struct(
                F.when(own, 0).otherwise(number).cast("int").alias("sub_index"),
                F.when(own, heading_id(F.col("id"))).otherwise(F.format_string("%s-line-heading-%d", F.col("id"), number)).alias("id"),
                F.when(own, F.col("text")).otherwise(x["ws"]).alias("text"),
                F.when(own, F.col("normalized_text")).otherwise(x["ws"]).alias("normalized_text"),
                x["level"].alias("level"),
                x["reason"].alias("reason"),
                x["ws"].alias("ws"),
            )

        return F.transform(found, named)

    # bound, as rules that push filters and merge projections copy what a column stands for
    headings = bound(F.filter(each, lambda x: x["kept"]), lambda kept: bound(distinct(kept), numbered))
    return rows.withColumn("own_headings", headings).drop("pieces", "contents")


def heading_blocks(texts: DataFrame) -> DataFrame:
    """The headings of text blocks, a row each: the block's columns with the heading's own."""
    rows = without(with_headings(texts), "h_").select("*", F.explode_outer("own_headings").alias("h")).where("h is not null")
    own = ("sub_index", "id", "text", "normalized_text", "level", "reason")
    return rows.drop("own_headings").withColumns({c: F.col("h")[c] for c in own}).drop("h")

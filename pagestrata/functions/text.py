"""Column functions on text: whitespace, lines, words and match forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The code points that count as white space, and those that end a line.
WS = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WS_BUT_LF = r"\t\x0b-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LINE_END = r"\r\n|[\n-\r\x1c-\x1e\x85\u2028\u2029]"
#: The spaces that normalization turns into U+0020.
SPACES = "\u00a0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f"


def whole(text: Column, pattern: str) -> Column:
    """Whether the pattern matches all of the text; false for null."""
    flags, body = ("(?iu)", pattern[4:]) if pattern.startswith("(?i)") else ("", pattern)
    return F.coalesce(text.rlike(rf"{flags}\A(?:{body})\z"), F.lit(False))


def found(text: Column, pattern: str) -> Column:
    """Whether the pattern matches somewhere; false for null."""
    flags, body = ("(?iu)", pattern[4:]) if pattern.startswith("(?i)") else ("", pattern)
    return F.coalesce(text.rlike(flags + body), F.lit(False))


def has(text: Column, part: str) -> Column:
    return F.coalesce(F.contains(text, F.lit(part)), F.lit(False))


def strip(text: Column) -> Column:
    # a run of white space is tried at its start alone: linear in the text
    return F.regexp_replace(text, rf"\A[{WS}]++|(?<![{WS}])[{WS}]++\z", "")


def match_text(text: Column) -> Column:
    """White space collapsed to single spaces and trimmed; empty for null."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), f"[{WS}]+", " "))


def normalize_text(text: Column) -> Column:
    """Line ends to LF, special spaces to U+0020, runs of spaces and tabs to one space, no
    space before a line end or at either end of the text, at most one blank line in a row."""
    lf = F.regexp_replace(text, r"\r\n|\r", "\n")
    plain = F.translate(lf, SPACES, " " * len(SPACES))
    tight = F.regexp_replace(F.regexp_replace(plain, "[ \t]+", " "), rf"(?<![{WS_BUT_LF}])[{WS_BUT_LF}]++(?=\n|\z)", "")
    return F.regexp_replace(strip(tight), r"\n{3,}", "\n\n")


def lines(text: Column) -> Column:
    """The stripped lines that are not blank."""
    each = F.transform(F.split(F.coalesce(text, F.lit("")), LINE_END), strip)
    return F.array_remove(each, "")


def words(collapsed: Column) -> Column:
    """The words of a collapsed text (see `match_text`)."""
    return F.array_remove(F.split(collapsed, " "), "")


def count(items: Column, test) -> Column:
    return F.size(F.filter(items, test))


def starts_lower(word: Column) -> Column:
    return found(word, r"\A\p{IsLowercase}")


def share(part: Column, total: Column) -> Column:
    """part / total, 0 where there is nothing."""
    return F.when(total > 0, part / F.greatest(total, F.lit(1))).otherwise(F.lit(0.0))


def any_mark(text: Column) -> Column:
    return found(text, "[.;:,]")


def chosen(rules: list[tuple[str, Column]], otherwise: str | None = None) -> Column:
    """The name of the first rule that holds: an ordered decision list as one CASE."""
    (name, test), *rest = rules
    out = F.when(test, F.lit(name))
    for name, test in rest:
        out = out.when(test, F.lit(name))
    return out.otherwise(F.lit(otherwise)) if otherwise is not None else out

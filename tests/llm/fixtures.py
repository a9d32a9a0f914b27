"""Rows that are hard on every operator."""

DOCUMENTS = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    # columns that clash with names the operators use inside
    "n long, fp long, key string, seed long, words array<string>, pos int, d double, g string, w long, size long, uid long, "
    "target string, taken string, score string, lang_pred string, spans string, comp long, digest string"
)
_EXTRA = (7, 7, "k", 7, ["w"], 7, 7.0, "g", 7, 7, 7, "t", "t", "s", "l", "s", 7, "d")

PROSE = "the cat sat on the mat and then the dog ran over the hill to see what was there before night fell on the town "


def row(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, None if text is None else len(text), *_EXTRA)


def hard_rows():
    long_word, long_text = "x" * 300_000, PROSE * 3000
    return [
        row(1, None, None, None),
        row(2, ""),
        row(3, " \t\n\x0b\x0c\r "),
        row(4, PROSE * 3),
        row(5, PROSE * 3, None),
        row(5, PROSE * 3, None),
        row(None, PROSE * 3, "en", None),
        row(6, long_word),
        row(7, long_text, "en", "b"),
        row(8, "one"),
        row(9, "one", "de"),
        row(10, "One TWO three four"),
        row(11, "\u4e2d\u6587 \U0001f600 \u00e9t\u00e9 123"),
        row(12, "12 34 !!"),
        row(13, PROSE * 3 + "and some more words that differ from the rest of it entirely so it seems"),
    ]


def hard(spark):
    return spark.createDataFrame(hard_rows(), DOCUMENTS)


def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagestrata.functions.text import lines, match_text, normalize_text

CASES = [
    ("a\r\nb\rc", "a\nb\nc"),
    ("a \t b", "a b"),
    ("a  b", "a b"),
    ("line one   \n  line two\t\n", "line one\n line two"),
    ("a\n\n\n\nb", "a\n\nb"),
    ("a\n \n \n \nb", "a\n\nb"),
    ("  \n\t ", ""),
    ("", ""),
    ("café   x", "café x"),
    ("a\x0b\nb", "a\nb"),
]


@pytest.fixture(scope="module")
def apply(spark):
    def run(function, texts):
        frame = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
        return [r[0] for r in frame.select(function(F.col("t")).alias("x"), "k").orderBy("k").collect()]

    return run


def test_normalization_cases(apply):
    assert apply(normalize_text, [c[0] for c in CASES]) == [c[1] for c in CASES]


def test_null_texts(apply):
    assert apply(normalize_text, [None]) == [None]
    assert apply(match_text, [None, " 　x\x1cy z "]) == ["", "x y z"]
    assert apply(lines, [None, "", " a \x85\x0b b\r\n\r\nc"]) == [[], [], ["a", "b", "c"]]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab \t\n\r\x0b\x0c\x1c\x85   　", max_size=30), min_size=30, max_size=60))
def test_properties(apply, texts):
    found = apply(normalize_text, texts)
    for before, after in zip(texts, found):
        # nothing but white space goes, and what stays keeps its order
        assert "".join(after.split()) == "".join(before.split())
        assert after == after.strip() and "\r" not in after and "\t" not in after and "  " not in after and "\n\n\n" not in after
        assert all(line == line.rstrip() for line in after.split("\n"))
        # words of a line stay on one line: only line feeds and carriage returns part lines
        parted = [x for x in re.split("[\r\n]", before) if x.strip()]
        assert [x.split() for x in after.split("\n") if x.strip()] == [x.split() for x in parted]
    assert apply(normalize_text, found) == found
    assert apply(match_text, texts) == [" ".join(t.split()) for t in texts]
    assert apply(lines, texts) == [[x.strip() for x in t.splitlines() if x.strip()] for t in texts]


def test_long_runs_of_spaces_take_linear_time(apply):
    run = " " * 1_000_000
    assert apply(normalize_text, [f"a{run}b", f"{run}a\n{run}b{run}", run]) == ["a b", "a\n b", ""]
    assert apply(lines, [f"a\u00a0{run}b\n{run}"]) == [[f"a\u00a0{run}b"]]

"""String banks through the rules, one Spark job each."""

from pyspark.sql import functions as F

from pagestrata.functions.text import match_text
from pagestrata.operators import furniture
from pagestrata.operators.figures import is_figure_caption
from pagestrata.operators.headings import heading_features, heading_id, is_contents_table
from pagestrata.operators.tables import table_features
from pagestrata.plans.queries import QUERIES

HEADINGS = {
    "ABSTRACT": 1,
    "Executive Summary": 1,
    "Overview": 2,
    "CHAPTER 2 - Methods": 1,
    "Annex B - Forms": 1,
    "TASK 101": 1,
    "Task 101 shall be performed by the contractor before delivery.": 1,
    "TASK SECTION 200 - ANALYSIS": 1,
    "APPENDIX A GUIDANCE": 1,
    "1. SCOPE": 1,
    "4. Detailed requirements": 1,
    "2.2 Government documents": 2,
    "4.3.1 Risk assessment": 3,
    "101.3 Details to be specified.": 2,
    "A.1.2 Application guidance": 2,
    "1.2 " + "x" * 100: 2,
}
PLAIN = [
    "",
    "1.1. Scope",
    "3. The contractor shall keep a record of the work and of the results",
    "2. This is prose",
    "SEE APPENDIX A FOR DETAILS",
    "Appendix B for the forms",
    "• item",
    "- item",
    "ab",
    "TASK 102 PLAN ..... 24",
    "https://example.org/a",
    "me@example.org",
    "MIL-STD-882E",
    "12",
    "MIX",
    "NATO-1",
    "This is a sentence.",
    "1.2 " + "x" * 101,
    "1.2 Ends with a stop.",
    "1.2 Two. Sentences here",
    "A.1 Ends like a sentence.",
    "ordinary words",
    "guide | Page 3 Monday, January 2, 2020",
]


def _headings(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    rows = heading_features(frame, F.col("t")).select("k", "h_is_heading", "h_level", "h_reason").orderBy("k").collect()
    return [(r["h_is_heading"], r["h_level"], r["h_reason"]) for r in rows]


def test_headings_and_levels(spark):
    found = _headings(spark, list(HEADINGS))
    assert {t: lvl for t, (yes, lvl, _) in zip(HEADINGS, found) if yes} == HEADINGS


def test_texts_that_are_no_headings(spark):
    found = _headings(spark, [*PLAIN, None])
    assert [r for r in zip(PLAIN, found) if r[1][0]] == []
    reasons = {t: r[2] for t, r in zip(PLAIN, found)}
    assert reasons[PLAIN[2]] == "no:numbered_body" and reasons["MIX"] == "no:roman" and reasons["MIL-STD-882E"] == "no:document_header"


def test_heading_ids(spark):
    frame = spark.createDataFrame([("page-1-text-2",), ("a-text-b-text-c",), ("other",)], "t string")
    assert [r[0] for r in frame.select(heading_id(F.col("t"))).collect()] == ["page-1-heading-2", "a-heading-b-text-c", "other-heading"]


def test_contents_tables(spark):
    texts = ["CONTENTS\nPARAGRAPH PAGE\n1. SCOPE ..... 1\nTASK ..... 24", "Contents of the page", "a 1\nb 2\nc iv\nCONTENTS PAGE", None]
    frame = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    assert [r[0] for r in frame.orderBy("k").select(is_contents_table(F.col("t"))).collect()] == [True, False, True, False]


def test_furniture_texts(spark):
    texts = ["12", "xii", "xiii", "IV", "Source: http://x", "please check the source to verify the current version", "source: verify", "a | page 3",
             "x" * 131 + " | Page 1", "x" * 132 + " | Page 1", "MIL-STD-882E w/CHANGE 1", "FTIAS  Manual", "1. MIL-STD-1"]
    frame = spark.createDataFrame(list(enumerate(texts)), "k int, t string").withColumn("ws", match_text(F.col("t"))).orderBy("k")
    ws = F.col("ws")
    rows = frame.select(furniture.is_page_number(ws), furniture.is_source_footer(ws), furniture.is_generic_footer(ws), furniture.is_document_header(ws)).collect()
    kinds = ["".join(k for k, yes in zip("nsgh", r) if yes) for r in rows]
    assert kinds == ["n", "n", "", "n", "s", "s", "s", "g", "g", "", "h", "h", ""]


def test_furniture_needs_height_and_place(spark):
    rows = [(1, "MIL-STD-882E", 20.0, 40.0, 800.0), (2, "MIL-STD-882E", 400.0, 420.0, 800.0), (3, "MIL-STD-882E", 20.0, 40.0, None),
            (4, "7", 780.0, 790.0, 800.0), (5, "7", 400.0, 420.0, 800.0), (6, "7", 20.0, 40.0, 0.0), (7, "7", None, None, 800.0)]
    frame = spark.createDataFrame(rows, "k int, ws string, y0 double, y1 double, h double")
    box = F.when(F.col("y0").isNotNull(), F.struct("y0", "y1"))
    found = frame.withColumns(furniture.flags(F.col("ws"), box, F.col("h"))).orderBy("k").collect()
    assert ["".join("x" if r[f"is_page_{f}"] else "-" for f in ("header", "footer", "number", "furniture")) for r in found] == [
        "x--x", "----", "----", "-xxx", "--xx", "--xx", "--xx",
    ]


def test_figure_captions(spark):
    texts = ["FIGURE 1. System", "figure A-3. The map", "Figure 2: Colon", "FIGURE 1.", "See FIGURE 1. System", "Figure IV. x y"]
    frame = spark.createDataFrame(list(enumerate(texts)), "k int, t string").orderBy("k")
    assert [r[0] for r in frame.select(is_figure_caption(F.col("t"))).collect()] == [True, True, False, False, False, False]


TABLES = {
    "TABLE II. Probability levels": (None, "caption"),
    "Table I shows the result of the work and so on": (None, "caption"),
    "C. Included additional tasks:": (None, "caption"),
    "c. Included additional tasks:": ("list_item", None),
    "(1)\ntext\n(2)\ntext": ("list_item", None),
    "Severity\nCategory\nDescription": (None, "header_terms"),
    "Probability levels": (None, "header_terms"),
    "Critical\n2": (None, "line_structure"),
    "Catastrophic\nI\nmay cause loss of life": (None, "line_structure"),
    "name  value\nfirst  1": (None, "line_structure"),
    "Element 4:\nIdentify and Document\nRisk Mitigation Measures": ("process_label", "line_structure"),
    "start\ninput\nend": ("process_label", None),
    "Hazard ID\nHazard Title\nHazard Description\nHazard Causes": ("form_labels", "line_structure"),
    "3.2.29 Risk. A combination of severity and of probability, for one item.": ("definition", None),
    "See Table I for severity categories.": ("table_reference", None),
    "table of values": ("table_reference", None),
    "Figure 2: System overview": ("figure_text", None),
    "as Figure 3 shows": ("figure_text", None),
    "Source: somewhere": ("source", None),
    "see https://example.org": ("link", None),
    "1. SCOPE ..... 1": ("dot_leader", None),
    "1. SCOPE": ("heading", None),
    "4.2 Assign a severity. The category is assigned by the team, as told.": ("section_prose", None),
    " ".join(["word"] * 30) + ".": ("long_prose", None),
    "mishap result criteria\nother": (None, "header_terms"),
    "ordinary body text": (None, None),
    "": ("empty", None),
}


def test_table_rules(spark):
    frame = spark.createDataFrame(list(enumerate(TABLES)), "k int, t string")
    rows = table_features(heading_features(frame, F.col("t")), F.col("t")).orderBy("k").select("t_reject_reason", "t_evidence", "t_is_candidate").collect()
    found = {t: (r[0], r[1]) for t, r in zip(TABLES, rows)}
    assert found == TABLES
    assert all(r[2] == (r[0] is None and r[1] is not None) for r in rows)


def test_cases_reach_every_rule(spark):
    rows = QUERIES["rule_cases"](spark, "").collect()
    reasons = {r["reason"] for r in rows}
    assert reasons == {
        "no:empty", "no:toc_entry", "no:numbered_body", "no:appendix_reference", "no:bullet", "no:short", "no:dots", "no:link", "no:dated_footer",
        "no:document_header", "no:digits", "no:roman", "no:acronym", "no:long", "no:sentence", "no:numbered", "no:plain", "yes:listed_title",
        "yes:chapter_or_annex", "yes:task_or_appendix", "yes:numbered", "yes:annex_section",
    }
    assert {r["reject_reason"] for r in rows} - {None} == {
        "empty", "dot_leader", "link", "source", "definition", "table_reference", "figure_text", "process_label", "form_labels", "section_prose",
        "list_item", "heading", "long_prose",
    }
    assert {r["evidence"] for r in rows} == {None, "caption", "header_terms", "line_structure"}
    for flag in ("is_candidate", "figure_internal", "is_caption", "is_number", "is_footer", "is_header"):
        assert {r[flag] for r in rows} == {True, False}

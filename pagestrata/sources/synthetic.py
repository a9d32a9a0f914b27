"""A block relation derived from the `orders` table, by integer arithmetic.

Order key k makes one block: document k div 130, page k % 5 + 1, class k % 26. Every
document holds each (page, class) pair once. Page 1 has no figure caption, page 2 one at
the bottom, page 3 one at the top, page 4 one without geometry, and page 5 no text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text of each class; @ stands for a line end. Odd documents capitalize class 17.
TEXTS = (
    "1. SCOPE",
    "2.2 Government documents",
    "101.3 Details to be specified.",
    "3. The contractor shall keep a record of the work and of the results",
    "MIL-STD-882E",
    "",
    "Source: https://example.org/doc -- Downloaded",
    "Guide | Page 12",
    "FIGURE 1. System overview",
    "Figure 2: System overview",
    "TABLE II. Probability levels",
    "Severity@Category@Description",
    "Critical@2",
    "Element 4:@Identify and Document@Risk Mitigation Measures",
    "Hazard ID@Hazard Title@Hazard Description@Hazard Causes",
    "3.2.29 Risk. A combination of severity and of probability, for one item.",
    "See Table I for severity categories.",
    "c. Included additional tasks:",
    "CONTENTS@PARAGRAPH PAGE@1. SCOPE ..... 1@TASK 102 PLAN ..... 24",
    "Body introduction here.@2. APPLICABLE DOCUMENTS",
    "TASK 101@HAZARD ANALYSIS",
    "System Risk@Accepted in accordance@with policy@5000 series",
    "   ",
    "This is ordinary body text.",
    "A B\r@C\t\tD  ",
    "Node Alpha one@Node Beta two@Node Gamma three",
)
BODY = TEXTS[23]

#: Texts on which every heading reason, table rejection and kind of evidence occurs.
CASES = (
    # headings
    "ABSTRACT", "Executive Summary", "Overview", "CHAPTER 2 - Methods", "Annex B - Forms", "TASK 101",
    "Task 101 shall be performed by the contractor before delivery.", "TASK SECTION 200 - ANALYSIS", "APPENDIX A GUIDANCE",
    "APPENDIX C - Forms to be used", "1. SCOPE", "4. Detailed requirements", "2.2 Government documents", "4.3.1 Risk assessment",
    "101.3 Details to be specified.", "A.1.2 Application guidance", "1.2 " + "x" * 100, "12. Plans for Every Season of Work",
    # texts that are none
    "", "1.1. Scope", "3. The contractor shall keep a record of the work and of the results", "2. This is prose",
    "7. one of the things that is to be done in the course of the year by all", "SEE APPENDIX A FOR DETAILS", "Refer to Appendix B for more",
    "Appendix B for the forms", "\u2022 item", "- item", "* item", "ab", "5", "TASK 102 PLAN ..... 24", "see ..... below", "https://example.org/a",
    "me@example.org", "MIL-STD-882E", "12", "1234", "MIX", "NATO-1", "This is a sentence.", "1.2 " + "x" * 101, "1.2 Ends with a stop.",
    "1.2 Two. Sentences here", "1.2 Is this one?", "A.1 Ends like a sentence.", "ordinary words", "words " * 25, "TASK " + "9 " + "long " * 30,
    "guide | Page 3 Monday, January 2, 2020", "200.1 " + "y" * 90 + ".",
    # furniture
    "xii", "xiii", "Check the source to verify that this is the current version", "Source: verify before use", "a | page 3", "FTIAS Manual",
    # tables
    "TABLE II. Probability levels", "Table I shows the result of the work and so on", "IV. Levels", "A-II. Levels", "C. Included additional tasks:",
    "c. Included additional tasks:", "(1)\ntext\n(2)\ntext", "(1)\ntext", "(1)\na\nb\nc", "Severity\nCategory\nDescription", "Severity and category of the description",
    "Probability levels", "Severity categories", "Critical\n2", "Catastrophic\nI\nmay cause loss of life", "Remote\nD\nshort", "Marginal\nx",
    "name  value\nfirst  1", "one two\nthree four\nfive six", "Element 4:\nIdentify and Document\nRisk Mitigation Measures", "Step 2:\nalone", "Process Step 3:",
    "start\ninput\nend", "start\nprocess", "decision\nother", "Hazard ID\nHazard Title\nHazard Description\nHazard Causes", "Report\nDate\nApproved by",
    "3.2.29 Risk. A combination of severity and of probability, for one item.", "3.2.30 Risk. Too short", "See Table I for severity categories.", "table of values",
    "Figure 2: System overview", "Figure A-3. The map", "as Figure 3 shows", "FIGURE 4. The plant", "Source: somewhere", "see https://example.org", "1. SCOPE ..... 1",
    "4.2 Assign a severity. The category is assigned by the team, as told.", "word " * 30 + "end.",
    "2. These are the words of a line that is longer than twelve words and more", "longwords and others that go on until the line has more than sixty-five characters in it, or so\nand another one of the same make that goes on and on for as long as the first line did too",
    "Many words start the first line of this\nand the next one goes on in lower case\nand so does the third of these lines", "mishap result criteria\nother",
    "System Risk\nof the plant", "- first point\n- second point", "- first point\n" + "x" * 71, "Node a\nNode b\nNode c", "Node a\nNode b\nLeaf c", "ordinary body text",
)


def case_texts(spark: SparkSession) -> DataFrame:
    """(case_id, text): the texts of CASES, numbered from 0."""
    return spark.createDataFrame([(k, text.strip(" ")) for k, text in enumerate(CASES)], "case_id long, text string")


def blocks_of_orders(orders: DataFrame) -> DataFrame:
    """Raw blocks (`schema.RAW_BLOCKS`), one per order."""
    k = F.col("o_orderkey")
    rows = orders.select(
        F.floor(k / 130).cast("int").alias("doc"), (k % 5 + 1).cast("int").alias("page_number"), (k % 26).cast("int").alias("class")
    )
    odd, page, kind = F.col("doc") % 2 == 1, F.col("page_number"), F.col("class")
    text = F.replace(F.element_at(F.array(*map(F.lit, TEXTS)), kind + 1), F.lit("@"), F.lit("\n"))
    text = (
        F.when(page == 5, " ")
        .when((page == 1) & (kind == 8), BODY)
        .when(kind == 5, F.col("doc").cast("string"))
        .when((kind == 17) & odd, "C. Included additional tasks:")
        .otherwise(text)
    )
    turn = F.col("doc") % 4
    x0 = F.when(kind == 21, F.when(turn == 3, 400.0).otherwise(100.0)).otherwise(80.0)
    x1 = F.when((kind == 21) & (turn == 3), 500.0).otherwise(300.0)
    grid = (60 + 25 * kind).cast("double")
    caption = F.when(page == 2, 700.0).when(page == 3, 40.0)
    y0 = (
        F.when(kind == 4, F.when(odd, 400.0).otherwise(20.0))
        .when((kind == 5) & ~odd, 760.0)
        .when(kind == 8, F.coalesce(caption, grid))
        .when(kind == 21, F.when(turn == 0, 430.0).when(turn == 1, 100.0).when(turn == 2, 300.0).otherwise(640.0))
        .otherwise(grid)
    )
    height = F.when(kind == 21, F.when(turn == 0, 70.0).when(turn == 2, 40.0).otherwise(50.0)).otherwise(20.0)
    placed = ~((page == 4) & kind.isin(8, 21))
    box = F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), (y0 + height).alias("y1"))
    name = F.format_string("manual-%d", "doc")
    return rows.select(
        F.concat(F.lit("/library/"), name, F.lit(".pdf")).alias("document_path"),
        name.alias("document_id"),
        "page_number",
        F.lit(612.0).alias("page_width"),
        F.lit(800.0).alias("page_height"),
        (kind + 1).alias("raw_ordinal"),
        F.when(placed, box).alias("bbox"),
        text.alias("text"),
        F.lit("synthetic").alias("extraction_method"),
        F.lit(1.0).alias("confidence"),
    )


def metadata_of_orders(orders: DataFrame) -> DataFrame:
    """Raw metadata of the documents above: blank fields, and all three keyword forms."""
    doc = F.floor(F.col("o_orderkey") / 130).cast("int")
    rows = orders.select(doc.alias("doc")).distinct()
    number = F.col("doc").cast("string")
    return rows.select(
        F.concat(F.lit("/library/manual-"), number, F.lit(".pdf")).alias("document_path"),
        F.concat(F.lit("  Manual "), number, F.lit("\t")).alias("title"),
        F.when(F.col("doc") % 3 == 0, " ").otherwise("A. Writer").alias("author"),
        F.lit("").alias("subject"),
        F.lit(None).cast("string").alias("producer"),
        F.lit("press").alias("creator"),
        F.when(F.col("doc") % 4 == 0, "safety, risk ,,a;b")
        .when(F.col("doc") % 4 == 1, "one; two;;three four")
        .when(F.col("doc") % 4 == 2, " alpha\tbeta  gamma ")
        .alias("keywords"),
    )

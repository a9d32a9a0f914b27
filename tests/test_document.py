import json

import pytest
from pyspark.sql import functions as F

from pagestrata.cli import main
from pagestrata.plans import document as plan
from pagestrata.plans.sql import register_views
from pagestrata.schema import RAW_BLOCKS, violations
from pagestrata.sinks.json import document_json, export_document
from pagestrata.sinks.markdown import document_markdown, export_markdown
from pagestrata.sources.readers import open_document, read_blocks, validated
from pagestrata.sources.synthetic import blocks_of_orders, metadata_of_orders
from pagestrata.streaming.pages import analyzed_stream, furniture_stream, nested_pages, page_stream


def raw_of(spark, rows):
    """(path, page, ordinal, text[, (y0, y1) or None]) as raw blocks."""
    full = []
    for path, page, ordinal, text, *place in rows:
        y = place[0] if place else (100.0 + 20 * ordinal, 115.0 + 20 * ordinal)
        box = y and (10.0, y[0], 100.0, y[1])
        full.append((path, path.rsplit("/", 1)[-1][:-4], page, 600.0, 800.0, ordinal, box, text, "test", 1.0))
    return spark.createDataFrame(full, RAW_BLOCKS)


def ids(blocks, *kinds):
    rows = plan.ordered(blocks).orderBy("document_path", "page_number", "position").collect()
    return [r["id"] for r in rows if not kinds or r["block_type"] in kinds]


def test_order_and_counters(spark):
    raw = raw_of(spark, [
        ("/a/m.pdf", 1, 0, "1. SCOPE"), ("/a/m.pdf", 1, 1, "  "), ("/a/m.pdf", 1, 2, "Body text here\n2. NOTES"), ("/a/m.pdf", 1, 3, "FIGURE 1. Map"),
        ("/a/m.pdf", 1, 4, "TABLE I. Levels"), ("/a/m.pdf", 1, 5, "12"), ("/a/m.pdf", 2, 0, "More text"), ("/b/m.pdf", 1, 0, "Other text"),
    ])
    blocks = plan.analyzed(raw).cache()
    assert ids(blocks) == [
        "page-1-text-1", "page-1-heading-1", "page-1-text-2", "page-1-text-2-line-heading-1", "page-1-text-3", "page-1-text-4", "page-1-text-5",
        "page-1-paragraph-1", "page-1-paragraph-2", "page-1-paragraph-3", "page-1-figure-1", "page-1-table-1",
        "page-2-text-1", "page-2-paragraph-1", "page-1-text-1", "page-1-paragraph-1",
    ]
    derived = plan.lineage_of_blocks(blocks)
    assert sorted(map(tuple, derived.collect())) == sorted(map(tuple, plan.lineage(raw).select(derived.columns).collect()))
    assert derived.count() == blocks.where("source_text_block_ids is not null").count()
    furniture = {r["id"] for r in blocks.where("is_page_furniture").collect()}
    assert furniture == {"page-1-text-5"}


def test_paragraphs_drop_texts_equal_to_a_heading_of_the_page(spark):
    raw = raw_of(spark, [("/m.pdf", 1, 0, "intro\n1. SCOPE"), ("/m.pdf", 1, 1, "1.  SCOPE"), ("/m.pdf", 2, 0, "1. scope of it all.")])
    assert ids(plan.analyzed(raw), "paragraph") == ["page-1-paragraph-1", "page-2-paragraph-1"]


def test_headings_of_a_block(spark):
    raw = raw_of(spark, [("/m.pdf", 1, 0, "TASK 101\nHAZARD ANALYSIS"), ("/m.pdf", 1, 1, "CONTENTS\nPARAGRAPH PAGE\n1. SCOPE ..... 1\nTASK 102 X ..... 2"),
                         ("/m.pdf", 1, 2, "x\n1. NOTES\n1. notes\n2. SCOPE")])
    rows = plan.of_kind(plan.analyzed(raw), "heading").orderBy("block_index", "sub_index").collect()
    assert [(r["block_index"], r["sub_index"], r["text"], r["level"]) for r in rows] == [
        (1, 0, "TASK 101\nHAZARD ANALYSIS", 1), (1, 1, "TASK 101", 1), (2, 1, "CONTENTS", 1), (3, 1, "1. NOTES", 1), (3, 2, "2. SCOPE", 1),
    ]


@pytest.mark.parametrize(
    ("caption", "label", "kept"),
    [
        ((700.0, 720.0), (430.0, 500.0), False),
        ((700.0, 720.0), (100.0, 150.0), True),
        ((700.0, 720.0), (300.0, 340.0), False),
        ((40.0, 60.0), (430.0, 500.0), True),
        ((40.0, 60.0), (300.0, 340.0), False),
        (None, (300.0, 340.0), False),
        ((700.0, 720.0), None, False),
    ],
)
def test_figure_context(spark, caption, label, kept):
    text = "System Risk\nAccepted in accordance\nwith policy\n5000 series"
    raw = raw_of(spark, [("/m.pdf", 1, 0, "FIGURE 1. Map", caption), ("/m.pdf", 1, 1, text, label)])
    assert bool(ids(plan.analyzed(raw), "table")) == kept


def test_pages_without_text_stay(spark):
    raw = raw_of(spark, [("/m.pdf", 1, 0, "text"), ("/m.pdf", 2, 0, None), ("/m.pdf", 3, 0, " ")])
    rows = plan.pages(raw).orderBy("page_number").collect()
    assert [(r["has_native_text"], r["requires_ocr"], len(r["blocks"])) for r in rows] == [(True, False, 2), (False, True, 0), (False, True, 0)]


def test_keywords_and_metadata(spark):
    rows = [("p", " t ", "", None, None, "c", "a, b;c,,")] + [(k, None, None, None, None, None, w) for k, w in (("q", "a b; c"), ("r", " x\ty "), ("s", " "), ("t", None))]
    frame = spark.createDataFrame(rows, "document_path string, title string, author string, subject string, producer string, creator string, keywords string")
    found = {r[0]: r[1] for r in plan.cleaned_metadata(frame).collect()}
    assert (found["p"]["title"], found["p"]["author"], found["p"]["creator"]) == ("t", None, "c")
    assert [found[k]["keywords"] for k in "pqrst"] == [["a", "b;c"], ["a b", "c"], ["x", "y"], [], []]


def test_json(spark, tmp_path):
    raw = raw_of(spark, [("/m.pdf", 1, 0, "1. SCOPE"), ("/m.pdf", 1, 1, "café  x"), ("/m.pdf", 2, 0, " ")])
    documents = plan.documents(raw)
    found = json.loads(document_json(documents).first()["json"])
    assert list(found) == ["id", "source_path", "metadata", "pages"] and found["metadata"]["keywords"] == []
    assert [p["page_number"] for p in found["pages"]] == [1, 2] and found["pages"][1]["blocks"] == []
    text, heading = found["pages"][0]["blocks"][:2]
    assert list(text) == ["id", "source", "block_type", "text", "normalized_text", "is_page_header", "is_page_footer", "is_page_number", "is_page_furniture"]
    assert list(heading)[-1] == "level" and heading["level"] == 1 and "is_page_header" not in heading
    assert found["pages"][0]["text_blocks"][0] == text
    assert text["source"]["bbox"] == {"x0": 10.0, "y0": 100.0, "x1": 100.0, "y1": 115.0}
    export_document(documents, str(tmp_path / "new" / "out.any"))
    written = (tmp_path / "new" / "out.any").read_text()
    assert "caf\\u00e9" in written and json.loads(written) == found


def test_markdown(spark, tmp_path):
    raw = raw_of(spark, [("/m.pdf", 1, 0, "12", None), ("/m.pdf", 1, 1, "a  b")])
    text = document_markdown(plan.documents(raw)).first()["markdown"]
    assert text == (
        "# m\n\nSource path: /m.pdf\n\n## Metadata\n\n- none\n\n## Page 1\n\n- has_native_text: True\n- requires_ocr: False\n\n"
        "Source: page 1, bbox None, method test, confidence 1.0\nPage furniture: yes\nPage number: yes\n\n12\n\n"
        "Source: page 1, bbox (10.0, 120.0, 100.0, 135.0), method test, confidence 1.0\nNormalized text available: yes\n\na  b\n"
    )
    export_markdown(plan.documents(raw), str(tmp_path / "x" / "m.md"))
    assert (tmp_path / "x" / "m.md").read_text() == text


def test_documents_with_metadata(spark):
    orders = spark.range(0, 300).withColumnRenamed("id", "o_orderkey")
    rows = plan.documents(blocks_of_orders(orders), metadata_of_orders(orders)).orderBy("id").collect()
    assert [r["id"] for r in rows] == ["manual-0", "manual-1", "manual-2"]
    assert rows[0]["metadata"]["title"] == "Manual 0" and [p["page_number"] for p in rows[0]["pages"]] == [1, 2, 3, 4, 5]


def test_stream_equals_batch(spark, tmp_path):
    orders = spark.range(0, 520).withColumnRenamed("id", "o_orderkey")
    raw = blocks_of_orders(orders)
    nested_pages(raw).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = page_stream(spark, str(tmp_path / "in"), 1)
    analyzed_stream(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out")).select("document_path", "id", "block_type", "text")
    batch = plan.analyzed(raw).select("document_path", "id", "block_type", "text")
    assert found.exceptAll(batch).isEmpty() and batch.exceptAll(found).isEmpty()
    query = furniture_stream(page_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("flags").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("flags").count() == plan.text_blocks(raw).count()


def test_plan_has_one_exchange(spark):
    raw = blocks_of_orders(spark.range(0, 260).withColumnRenamed("id", "o_orderkey"))
    text = plan.analyzed(raw)._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1 and "Python" not in text


def test_views(spark):
    register_views(blocks_of_orders(spark.range(0, 260).withColumnRenamed("id", "o_orderkey")), "v_")
    rows = spark.sql("SELECT block_type, count(*) n FROM v_blocks GROUP BY ROLLUP (block_type)").collect()
    assert len(rows) == 6


def test_sources(spark, tmp_path):
    raw = raw_of(spark, [("/m.pdf", 1, 0, "x")])
    raw.write.parquet(str(tmp_path / "raw"))
    assert read_blocks(spark, str(tmp_path / "raw")).count() == 1
    broken = raw.withColumn("confidence", F.lit(2.0)).withColumn("bbox", F.col("bbox").withField("x1", F.lit(0.0)))
    assert broken.select(violations().alias("v")).first()["v"] == ["bbox_x", "confidence"]
    broken.write.parquet(str(tmp_path / "broken"))
    with pytest.raises(Exception, match="bbox_x"):
        read_blocks(spark, str(tmp_path / "broken"), strict=True).collect()
    with pytest.raises(ValueError, match="Unsupported file type: <none>"):
        validated("name")
    with pytest.raises(ValueError, match=r"Unsupported file type: \.docx"):
        validated("a.docx")
    with pytest.raises(FileNotFoundError):
        validated(str(tmp_path / "missing.PDF"))


def test_command_line(spark, tmp_path, capsys):
    assert main([str(tmp_path / "none.pdf"), "-o", str(tmp_path / "o.json")]) == 1
    assert "Error:" in capsys.readouterr().err and not (tmp_path / "o.json").exists()
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4")
    try:
        import fitz  # noqa: F401
    except ImportError:
        with pytest.raises(Exception, match="PyMuPDF"):
            open_document(spark, str(tmp_path / "a.pdf"))[0].collect()


class FakeDocument(list):
    metadata = {"title": " T ", "author": 7, "keywords": "a, b"}

    def __enter__(self):
        return self

    def __exit__(self, *_):
        pass


class FakePage:
    def __init__(self, blocks):
        self.blocks, self.rect = blocks, type("Rect", (), {"width": 612, "height": 792})

    def get_text(self, form):
        assert form == "blocks"
        return self.blocks


def test_pdf_pages_become_raw_blocks(spark, monkeypatch):
    import pandas as pd

    from pagestrata.sources import pdf

    pages = FakeDocument([FakePage([(1.0, 2.0, 3.0, 4.0, "one", 0, 0), (1.0, 5.0, 3.0, 8.0, " ", 1, 0), (0, 0), (1.0, 9.0, 3.0, 12.0, "two")]), FakePage([])])
    monkeypatch.setattr(pdf, "_opened", lambda content: pages)
    files = pd.DataFrame({"path": ["file:/a b/x[1].pdf"], "content": [b""]})
    rows = pd.concat(pdf._blocks(iter([files])))
    assert list(rows.columns) == RAW_BLOCKS.names and set(rows["document_path"]) == {"/a b/x[1].pdf"} and set(rows["document_id"]) == {"x[1]"}
    plain = rows.astype(object).where(rows.notna(), None).to_dict("records")
    raw = spark.createDataFrame([{k: float(v) if k == "confidence" and v else v for k, v in r.items()} for r in plain], RAW_BLOCKS)
    assert [(r["page_number"], r["id"], r["text"]) for r in plan.text_blocks(raw).orderBy("block_index").collect()] == [(1, "page-1-text-1", "one"), (1, "page-1-text-2", "two")]
    assert {r["page_number"]: r["requires_ocr"] for r in plan.page_status(raw).collect()} == {1: False, 2: True}
    known = next(pdf._metadata(iter([files]))).iloc[0]
    assert known["title"] == " T " and known["author"] is None and known["keywords"] == "a, b"


def test_file_names_are_no_patterns(spark, tmp_path):
    from pagestrata.sources.pdf import _files
    from pagestrata.sources.readers import no_pattern

    for name in ("x[1].pdf", "x1.pdf", "a b*.PDF"):
        (tmp_path / name).write_bytes(name.encode())
    for name in ("x[1].pdf", "a b*.PDF"):
        assert [bytes(r["content"]).decode() for r in _files(spark, no_pattern(str(tmp_path / name))).collect()] == [name]


def test_strict_reading_checks_whatever_is_read(spark, tmp_path):
    raw_of(spark, [("/m.pdf", 0, 0, "x")]).write.parquet(str(tmp_path / "raw"))
    with pytest.raises(Exception, match="page_number"):
        read_blocks(spark, str(tmp_path / "raw"), strict=True).select("text").collect()

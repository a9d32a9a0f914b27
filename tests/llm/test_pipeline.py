import zlib

import corpus_pipeline
import pytest

import __spark_entry__ as driver
from pagestrata.llm import decontamination, language_id, pii, store
from pagestrata.llm.oracles import ORACLE_SQL
from pagestrata.llm.queries import QUERIES
from tests.compare import spark_rows, sql_rows

from .fixtures import empty, hard
from .test_pairs import brute_components, brute_overlaps

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    assert spark_rows(QUERIES[name](spark, FOLDER)) == sql_rows(ORACLE_SQL[name], FOLDER)


def test_registered():
    assert {f"op{n}" for n in range(1, 11)} == {k.split("_")[0] for k in QUERIES} and "pipeline" in driver.queries()


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    texts = {lang: sorted(r["text"] for r in rows.values() if r["lang"] == lang and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2) for lang in {r["lang"] for r in rows.values()}}
    import pyarrow as pa

    ids = sorted(rows)
    langs, scores, excess = language_id.predict(language_id.train(texts), pa.array([rows[i]["text"] for i in ids]))
    kept = [i for i, lang, s, x in zip(ids, langs, scores, excess) if lang != "und" and s >= 0.5 and (x <= 4 or len(rows[i]["text"].encode()) < 100)]
    first = [i for i, (_, _, c) in zip(sorted(kept, key=str), brute_components([(i, rows[i]["text"]) for i in kept])) if str(i) == c]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    bad = {k.split(",")[0][1:] for k in brute_overlaps([(i, rows[i]["text"]) for i in first], items)}
    clean = sorted(i for i in first if str(i) not in bad)
    found = {r["doc_id"]: r for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert sorted(found) == clean
    # only the result is left of this run's tables
    import os

    folder = store.shared_folder(spark)
    with store.intermediates(spark):
        path = store.written(spark.range(3), "probe").inputFiles()[0].removeprefix("file://")
        assert os.path.exists(path)
    assert not os.path.exists(path)
    assert len([x for x in os.listdir(folder.removeprefix("file:")) if x.startswith("pipeline-")]) == 1
    automaton = pii._automaton()
    for i in clean:
        assert found[i]["text"] == pii.mask(rows[i]["text"], pii.find_spans(rows[i]["text"], automaton))
        assert found[i]["taken"] <= 3 * found[i]["size"]


def test_stages_keep_columns_of_hard_rows(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontaminate", "redact", "mix"]
    for docs in (hard(spark), empty(spark)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, docs, FOLDER)
            assert kept.columns == docs.columns and kept.count() <= docs.count()
        assert corpus_pipeline.mix(spark, docs, FOLDER).count() == docs.count()


def test_only_the_entry_imports_the_subpackage():
    from pathlib import Path

    root = Path(driver.__file__).parent / "pagestrata"
    for path in root.rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text()
    assert decontamination.lossless()

import pytest

from pagestrata.plans.oracles import ORACLE_SQL
from pagestrata.plans.queries import QUERIES

from .compare import spark_rows, sql_rows

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    assert spark_rows(QUERIES[name](spark, FOLDER)) == sql_rows(ORACLE_SQL[name], FOLDER)


def test_html_blocks(spark):
    rows = QUERIES["html_as_blocks"](spark, FOLDER).collect()
    assert len(rows) == 50 and all(r["n_blocks"] > 0 for r in rows)

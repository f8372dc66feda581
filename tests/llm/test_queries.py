"""Each query over the smallest tables: against its SQL, or for a row of every input row."""

import pytest

import __spark_entry__ as contract
from clusterloom.llm.oracle import ORACLE_SQL
from clusterloom.llm.queries import QUERIES
from tests.conftest import SF_DIR
from tests.test_oracle import canonical


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_oracle(spark, duck, name):
    result = QUERIES[name](spark, SF_DIR)
    cursor = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(result.columns)
    order = sorted(names)
    got = canonical(result.collect(), [result.columns.index(n) for n in order])
    assert got == canonical(cursor.fetchall(), [names.index(n) for n in order]) and got


@pytest.mark.parametrize(("name", "table", "key"), [
    ("op3_toxicity", "documents", "doc_id"), ("op5_simhash", "documents", "doc_id"),
    ("op8_html_text", "pages", "page_id"), ("op9_mixing", "documents", "doc_id"),
    ("op10_fingerprints", "documents", "doc_id"),
])
def test_one_row_for_each_row(spark, name, table, key):
    rows = QUERIES[name](spark, SF_DIR).select(key).collect()
    assert sorted(r[0] for r in rows) == sorted(r[0] for r in spark.read.parquet(f"{SF_DIR}/{table}.parquet").select(key).collect())


def test_all_are_registered():
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLE_SQL) <= set(contract.oracle_sql())

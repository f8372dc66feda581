"""Every registered query against its SQL counterpart."""

import math

import pytest

import __spark_entry__ as contract
from clusterloom.plans.oracle import ORACLE_SQL as ORACLE
from clusterloom.plans.queries import QUERIES
from tests.conftest import SF_DIR


def canonical(rows, order):
    """Rows as sorted text, with columns by name and integral floats unified."""
    def cell(value):
        if value is None or (isinstance(value, float) and math.isnan(value)):
            return ""
        if isinstance(value, (bool, str)):
            return str(value)
        return repr(float(value))

    return sorted(tuple(cell(row[i]) for i in order) for row in rows)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(contract.queries())
    assert set(ORACLE) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_oracle(spark, duck, name):
    result = QUERIES[name](spark, SF_DIR)
    cursor = duck.execute(ORACLE[name])
    expected_names = [d[0] for d in cursor.description]
    assert sorted(result.columns) == sorted(expected_names)
    names = sorted(expected_names)
    got = canonical(result.collect(), [result.columns.index(n) for n in names])
    want = canonical(cursor.fetchall(), [expected_names.index(n) for n in names])
    assert got
    assert got == want


def test_entry_runs(spark):
    assert contract.entry(spark).collect()[0]["url"].startswith("http://maps.google.com/")

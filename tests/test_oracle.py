"""Every registered query against its SQL on the smallest data set."""

import pytest

import __spark_entry__ as entry_points
from tests.conftest import SF
from tools.check_oracle import compare, connect

QUERIES = {n: q for n, q in entry_points.queries().items() if n not in entry_points.LLM_QUERIES}
SQL = {n: q for n, q in entry_points.oracle_sql().items() if n in QUERIES}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    _, error = compare(spark, con, QUERIES[name], SQL[name], SF)
    assert error is None


def test_entry(spark):
    assert entry_points.entry(spark).columns == ["date", "transactions", "success_rate", "fees"]

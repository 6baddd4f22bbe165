"""Every named query against its SQL on the smallest tables."""

import pytest
from compare import connect, difference
from conftest import DATA

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()
# queries of the optional text package that have no SQL are tested with that package
OWN = set(entry.TEXT_QUERIES)


@pytest.fixture(scope="module")
def duck():
    return connect(DATA)


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, duck, name):
    assert difference(QUERIES[name](spark, DATA), duck, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - OWN))
def test_query_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 8

"""Every registered query next to its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
import check_queries
from riskloom.plans import catalog, oracles

SMALL = "/root/testdata/sf0.001"
SQL = oracles.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return check_queries.connect(SMALL)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    _, rows, problem = check_queries.compare(spark, con, SMALL, name, catalog.QUERIES[name], SQL.get(name))
    assert problem is None
    assert rows >= 0


def test_every_query_has_sql():
    assert set(SQL) == set(catalog.QUERIES)
    assert set(SQL) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0

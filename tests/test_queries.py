"""Every registered query against its SQL twin, on the smallest tables."""

import pytest
from compare import connect, difference

import __spark_entry__ as contract

# the corpus queries have tests of their own
QUERIES = {k: f for k, f in contract.queries().items() if k in contract.QUERIES}
SQL = {k: s for k, s in contract.oracle_sql().items() if k in contract.QUERIES}


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


def test_every_query_is_stated():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf, duck, name):
    assert difference(QUERIES[name](spark, sf), duck, SQL[name]) is None


def test_flagship(spark):
    assert contract.entry(spark).count() > 0

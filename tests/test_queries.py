"""Every registered query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from reviewloom.plans import catalog, oracles
from tests.oracle_check import compare, connect

QUERIES, SQL = catalog.registered(), oracles.registered_sql()
NO_SQL = {"themes_kmeans", "themes_selected", "words_alike"}


@pytest.fixture(scope="module")
def db(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equal_to_sql(spark, sf, db, name):
    assert compare(spark, db, sf, QUERIES[name], SQL[name]) is None


@pytest.mark.parametrize("name", sorted(NO_SQL))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_all_queries_are_covered():
    assert set(QUERIES) == set(SQL) | NO_SQL
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["query_id", "sentence", "rank", "score", "review_id", "summary", "rating"]
    assert df.count() > 0

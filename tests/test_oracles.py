"""Every registered query with an SQL twin gives the twin's rows."""

import pytest
from oracle import compare, connect

from veritab.queries import all_queries, all_sql

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = all_queries(), all_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, con, name):
    assert compare(QUERIES[name](spark, FOLDER), con, SQL[name]) is None

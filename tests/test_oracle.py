"""Every registered query with SQL must equal it, at the smallest scale."""

import re

import pytest
from check import connect, differences

from __spark_entry__ import entry, oracle_sql, queries

SF = "/root/testdata/sf0.001"
#: The text operators have tests of their own.
TEXT = re.compile(r"op\d+_|pipeline$")
QUERIES = {k: v for k, v in queries().items() if not TEXT.match(k)}
SQL = {k: v for k, v in oracle_sql().items() if not TEXT.match(k)}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in SQL:
        want = con.execute(SQL[name]).df()
        assert differences(got, want) == ""
    else:
        assert len(got) > 0


def test_sql_has_queries():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert entry(spark).limit(1).count() == 1

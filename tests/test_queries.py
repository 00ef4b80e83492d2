"""Every registered query on the small tables, against DuckDB where it has SQL."""

import pytest

import __spark_entry__ as entry
from compare import check, connect

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    problem = check(spark, con, name, QUERIES[name], ORACLE.get(name), SF)
    assert not problem, problem


def test_oracle_names():
    assert set(ORACLE) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).columns

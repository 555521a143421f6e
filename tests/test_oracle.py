"""Every registered query with check SQL gives the same rows as DuckDB on the small driver tables."""

import oracle
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle.duck(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, con, name):
    problem, rows, *_ = oracle.compare(spark, con, FOLDER, entry.queries()[name], SQL[name])
    assert problem is None


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0

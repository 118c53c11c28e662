"""Every query with SQL equals it; every other query runs."""

import pytest

import __spark_entry__ as entry
from compare import connect, difference

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, sf_dir, name):
    assert difference(con, SQL[name], QUERIES[name](spark, sf_dir)) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert len(df.columns) > 0 and df.count() > 0


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and all(0 <= r["cat_reorder_rate"] <= 1 for r in rows)

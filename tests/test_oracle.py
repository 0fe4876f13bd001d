"""Every registered query against its SQL twin on the smallest tables."""

import pytest
from compare import compare, duck

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


def test_names_match():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    if name in SQL:
        diff, _ = compare(df, con, SQL[name])
        assert diff is None, diff
    else:
        df.collect()


def test_entry(spark):
    assert entry.entry(spark).count() > 0

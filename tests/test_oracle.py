"""Every registered query next to its SQL twin, over whole tables."""

import pytest

import __spark_entry__ as entry
from oracle import compare, connect

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, sf, name):
    fn = entry.queries()[name]
    if name in SQL:
        assert compare(spark, con, sf, fn, SQL[name]) is None
    else:
        df = fn(spark, sf)
        assert df.columns and df.count() > 0


def test_every_sql_has_its_query():
    assert set(SQL) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0

"""Every registered query against its SQL twin, at the smallest scale."""

import pytest

import __spark_entry__ as entry
from tests.conftest import SMALL
from tests.oracle import compare, connect

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = connect(SMALL)
    yield con
    con.close()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    if name in SQL:
        ok, note = compare(df, duck, SQL[name])
        assert ok, note
    else:
        assert df.count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "file_id" and df.count() == 200


def test_sql_names_exist():
    assert set(SQL) <= set(QUERIES)

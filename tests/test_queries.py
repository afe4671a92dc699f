"""Every core query that has SQL gives the SQL's rows on the smallest tables; the others give rows."""

import pytest
from compare import connection, difference
from conftest import SMALL

from quillgraph.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connection(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SMALL)
    if name in SQL:
        assert difference(df, con, SQL[name]) == ""
    else:
        assert df.count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns and df.count() > 0
    assert set(catalog.queries()) <= set(e.queries())

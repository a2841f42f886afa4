import os

import pytest

from ouzel.queries import QUERIES, SQL

from .compare import assert_same, connect

PLACE = os.environ.get("OUZEL_TESTDATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(PLACE), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(PLACE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, PLACE)
    if name in SQL:
        assert_same(df, con, SQL[name])
    else:
        assert len(df.columns) == len(set(df.columns)) and df.count() >= 0


def test_every_sql_has_its_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1

import os
import re

import pytest

from ouzel.llm.queries import QUERIES, SQL

from ..compare import assert_same, connect

PLACE = os.environ.get("OUZEL_TESTDATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(PLACE), reason="no test tables")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, PLACE)
    if name in SQL:
        assert_same(df, connect(PLACE), SQL[name])
    else:
        assert df.count() > 0


def test_nothing_else_imports_this():
    from pathlib import Path

    root = Path(__file__).resolve().parents[2]
    for f in [*root.glob("ouzel/**/*.py"), *root.glob("tests/*.py")]:
        if "llm" not in f.parts:
            assert not re.search(r"\.llm\b|\bimport llm\b", f.read_text())

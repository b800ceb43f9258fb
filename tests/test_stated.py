from __future__ import annotations

import duckdb
import pytest

from quireframe.plans import texts


@pytest.mark.parametrize("name", list(texts.QUERIES))
def test_rows_are_as_stated(spark, name):
    df = texts.QUERIES[name](spark, "")
    want = duckdb.connect().sql(texts.SQL[name]).select(*(f'"{c}"' for c in df.columns)).fetchall()
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want)) and want

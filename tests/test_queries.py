from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.test_corpus import EDITH, HERRING

BOOKS = [(1, "edith", EDITH), (2, "herring", HERRING), (30, "none", None), (31, "empty", "")]


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    """Small tables in a folder, as queries read them."""
    d = str(tmp_path_factory.mktemp("store"))
    put = lambda name, data, schema: spark.createDataFrame(data, schema).write.parquet(f"{d}/{name}.parquet")
    put("book", BOOKS, "book_id long, name string, content string")
    put("corpus", [(1, "a"), (2, "b"), (3, "c")], "corpus_id int, name string")
    put("corpus_book", [(1, 2), (1, 2), (2, 30), (2, 31), (3, 99)], "corpus_id int, book_id long")
    put("rclass", [(301, "chapter.text"), (503, "quote")], "rclass_id int, name string")
    put("text_region", [(2, 301, 34, len(HERRING), 1), (2, 301, 34, len(HERRING), 1), (2, 503, 0, 7, None), (30, 503, 0, 5, None), (1, 999, 0, 5, None)], "book_id long, rclass_id int, r_start int, r_end int, rvalue int")
    return d


def test_whole_books(spark, store, rows):
    got = rows(entry.queries()["exact_tokens"](spark, store))
    assert {r[0] for r in got} == {1, 2} and (2, 0, 7, "herring") in got and len(got) == len(set(got))
    regions = rows(entry.queries()["tagged_regions"](spark, store))
    assert {r[0] for r in regions} >= {1, 2} and (1, 101, 0, 5) in [r[:4] for r in regions]


def test_line_texts():
    got = entry.queries()
    assert {"exact_tokens", "tagged_regions", "conc_texts"} <= got.keys() and not {"exact_tokens", "tagged_regions", "conc_texts"} & entry.oracle_sql().keys()


def test_corpora_of_all_books(spark, store, rows):
    assert rows(entry.queries()["corpora_with_texts"](spark, store)) == [(1,)]


def test_previews_of_every_region(spark, store, rows):
    got = rows(entry.queries()["region_previews"](spark, store))
    text = HERRING[34:]
    assert got == sorted([("herring", "chapter.text", 34, len(HERRING), 1, (text[:20] + "..." + text[-20:]).replace("\n", " ")), ("herring", "quote", 0, 7, None, "Herring"), ("none", "quote", 0, 5, None, None), ("edith", None, 0, 5, None, "Edith")], key=repr)

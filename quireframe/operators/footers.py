"""What a result says about its books: titles, where chapters start, words before chapters, words in all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quireframe.operators.corpora import titles
from quireframe.schema import subset_id


def chapter_starts(reg: DataFrame) -> DataFrame:
    """``book_id, chapter, start`` from chapter texts, the first of several; and the last end under ``_end``.

    Chapters are text, as keys of a footer are; a text without number has a null chapter.
    """
    text = reg.where("rclass_id = 301")
    starts = text.groupBy("book_id", F.col("rvalue").cast("string").alias("chapter")).agg(F.min("r_start").alias("start"))
    return starts.unionByName(text.groupBy("book_id").agg(F.lit("_end").alias("chapter"), F.max("r_end").alias("start")))


def words_before(counts: DataFrame, rclass: int = 301) -> DataFrame:
    """``book_id, chapter, words``: words of the book before each chapter, and in all under ``_end``.

    ``counts`` is ``book_id, rclass_id, rvalue, word_count`` by region; several texts of one chapter are added first.
    """
    rows = counts.where(F.col("rclass_id") == rclass).groupBy("book_id", "rvalue").agg(F.sum("word_count").alias("n"))
    w = Window.partitionBy("book_id").orderBy("rvalue").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.select("book_id", F.col("rvalue").cast("string").alias("chapter"), F.coalesce(F.sum("n").over(w), F.lit(0).cast("long")).alias("words"))
    return before.unionByName(rows.groupBy("book_id").agg(F.lit("_end").alias("chapter"), F.sum("n").alias("words")))


def words_in(counts: DataFrame, rclass: int) -> DataFrame:
    """``book_id, words`` of a class."""
    return counts.where(F.col("rclass_id") == rclass).groupBy("book_id").agg(F.sum("word_count").alias("words"))


def footer(items: Sequence[str], reg: DataFrame, counts: DataFrame, meta: DataFrame) -> dict[str, DataFrame]:
    """The tables that ``items`` name: book_titles, chapter_start, word_count_chapter, word_count_<subset>."""
    out = {}
    for item in items:
        if item == "book_titles":
            out[item] = titles(meta)
        elif item == "chapter_start":
            out[item] = chapter_starts(reg)
        elif item == "word_count_chapter":
            out[item] = words_before(counts)
        elif item.startswith("word_count_"):
            out[item] = words_in(counts, subset_id(item.removeprefix("word_count_")))
        else:
            raise ValueError(f"Unknown metadata: {item}")
    return out

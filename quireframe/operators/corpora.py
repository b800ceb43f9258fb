"""Corpora, their books and authors; what a request means by a corpus."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireframe.errors import UserError


def titles(meta: DataFrame) -> DataFrame:
    """``book_id, title, author`` of books that have either, null for a missing part; of several the greatest stands."""
    return meta.where(F.col("rclass_id").isin(101, 102)).groupBy("book_id").agg(F.max(F.when(F.col("rclass_id") == 101, F.col("content"))).alias("title"), F.max(F.when(F.col("rclass_id") == 102, F.col("content"))).alias("author"))


def links(corpus_book: DataFrame) -> DataFrame:
    """Corpus and book, each pair once."""
    return corpus_book.select("corpus_id", "book_id").distinct()


def listing(corpus: DataFrame, corpus_book: DataFrame, book: DataFrame, meta: DataFrame) -> DataFrame:
    """A row per corpus and book with a title or author: ``corpus_name, corpus_title, ordering, book_name, title, author``."""
    rows = links(corpus_book).join(corpus.select("corpus_id", F.col("name").alias("corpus_name"), F.col("title").alias("corpus_title"), "ordering"), "corpus_id")
    return rows.join(titles(meta), "book_id").join(book.select("book_id", F.col("name").alias("book_name")), "book_id").select("corpus_name", "corpus_title", "ordering", "book_id", "book_name", "title", "author")


def nested_listing(rows: DataFrame) -> DataFrame:
    """``listing`` as one row per corpus with its books as an array, in the order of the corpora and names."""
    books = F.array_sort(F.collect_list(F.struct(F.col("book_name").alias("id"), "title", "author")))
    return rows.groupBy("ordering", "corpus_title", "corpus_name").agg(books.alias("children")).orderBy("ordering", "corpus_title")


def books_per_author(rows: DataFrame) -> DataFrame:
    """``author, books``: how often an author's books occur in corpora; without author first."""
    return rows.groupBy("author").agg(F.count(F.lit(1)).alias("books")).orderBy(F.asc_nulls_first("author"))


def headlines(corpus: DataFrame, corpus_book: DataFrame, words: DataFrame, tok_class: int = 301) -> DataFrame:
    """``name, title, book_count, word_count`` per corpus that has a book; ``words`` is ``book_id, rclass_id, word_count``."""
    per_book = words.where(F.col("rclass_id") == tok_class).groupBy("book_id").agg(F.sum("word_count").alias("n"))
    rows = links(corpus_book).join(per_book, "book_id", "left").groupBy("corpus_id").agg(F.count(F.lit(1)).alias("book_count"), F.sum("n").alias("word_count"))
    return corpus.join(rows, "corpus_id").select("name", "title", "ordering", "book_count", F.coalesce("word_count", F.lit(0).cast("long")).alias("word_count"))


def image(corpus: DataFrame, name: str) -> DataFrame:
    """The image of one corpus."""
    return corpus.where(F.col("name") == name.removeprefix("corpus:")).select(F.col("carousel_image").alias("image"))


def resolve(specs: Sequence[str | int], corpus: DataFrame, corpus_book: DataFrame, book: DataFrame, meta: DataFrame, aliases: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """The distinct ``book_id`` that ``specs`` mean: ids, ``corpus:NAME``, ``author:NAME``, names of books, or aliases of specs.

    All specs of a kind are looked up together, so that the plan has a few joins however many there are. Ids that two
    specs mean come once.
    """
    if not specs:
        raise UserError("No books to search")
    flat: list[str | int] = []
    todo = list(specs)
    while todo:
        s = todo.pop(0)
        if isinstance(s, str) and s in (aliases or {}):
            todo = [*aliases[s], *todo]
        else:
            flat.append(s)
    ids = [s for s in flat if isinstance(s, int)]
    named = [s for s in flat if isinstance(s, str)]
    corpora = [s.removeprefix("corpus:") for s in named if s.startswith("corpus:")]
    authors = [s.removeprefix("author:") for s in named if s.startswith("author:")]
    names = [s for s in named if not s.startswith(("corpus:", "author:"))]
    out = book.where(F.col("book_id").isin(ids) | F.col("name").isin(names)).select("book_id")
    if corpora:
        out = out.unionByName(corpus_book.join(F.broadcast(corpus.where(F.col("name").isin(corpora)).select("corpus_id")), "corpus_id", "left_semi").select("book_id"))
    if authors:
        out = out.unionByName(meta.where((F.col("rclass_id") == 102) & F.col("content").isin(authors)).select("book_id"))
    return out.distinct()

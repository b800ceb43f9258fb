"""Word lists and clusters: n adjacent tokens of a subset, counted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quireframe.errors import UserError
from quireframe.operators.store import blocked, in_class


def ngrams(tok: DataFrame, rclass: int | None, n: int = 1) -> DataFrame:
    """``book_id, ordering, ngram`` for every run of ``n`` tokens of the class that are adjacent in the whole text.

    Tokens outside the class leave holes, so that nothing straddles a heading or, within speech, narration. A run
    with a token without type is none. ``ordering`` is that of the run's first token. Repeated rows count once.
    """
    if n < 1:
        raise UserError("A cluster has at least one token")
    rows = (tok if rclass is None else tok.where(in_class(rclass))).select("book_id", "ordering", "ttype")
    if n == 1:
        return rows.where("ttype is not null").distinct().withColumnRenamed("ttype", "ngram")
    w = Window.partitionBy("book_id", "blk").orderBy("ordering")
    words = [F.col("ttype"), *(F.lead("ttype", i).over(w) for i in range(1, n))]
    # one exchange by book and block serves the removal of copies and the window
    own = blocked(rows, "ordering", 0, n - 1).repartition("book_id", "blk").dropDuplicates(["book_id", "blk", "ordering"])
    runs = own.select("book_id", "ordering", "own", F.lead("ordering", n - 1).over(w).alias("last"), F.array(*words).alias("words"))
    return runs.where(F.col("own") & (F.col("last") - F.col("ordering") == n - 1) & ~F.exists("words", lambda x: x.isNull())).select("book_id", "ordering", F.array_join("words", " ").alias("ngram"))


def counts_by_class(tok: DataFrame, rclasses: Sequence[int], n: int = 1) -> DataFrame:
    """``ngram, n0, n1, ..``: the word lists of several classes from one scan; a cluster lies wholly within each it counts for."""
    if n < 1:
        raise UserError("A cluster has at least one token")
    inside = [in_class(c).alias(f"i{k}") for k, c in enumerate(rclasses)]
    rows = tok.select("book_id", "ordering", "ttype", *inside).where(" or ".join(f"i{k}" for k in range(len(inside))))
    if n == 1:
        each = rows.where("ttype is not null").distinct().withColumnRenamed("ttype", "ngram")
        whole = [F.col(f"i{k}") for k in range(len(inside))]
    else:
        w = Window.partitionBy("book_id", "blk").orderBy("ordering")
        ahead = lambda c: F.array(F.col(c), *(F.lead(c, j).over(w) for j in range(1, n)))
        own = blocked(rows, "ordering", 0, n - 1).repartition("book_id", "blk").dropDuplicates(["book_id", "blk", "ordering"])
        runs = own.select("ordering", "own", F.lead("ordering", n - 1).over(w).alias("last"), ahead("ttype").alias("words"), *(ahead(f"i{k}").alias(f"a{k}") for k in range(len(inside))))
        each = runs.where(F.col("own") & (F.col("last") - F.col("ordering") == n - 1) & ~F.exists("words", lambda x: x.isNull())).withColumn("ngram", F.array_join("words", " "))
        whole = [F.forall(f"a{k}", lambda x: x) for k in range(len(inside))]
    return each.groupBy("ngram").agg(*(F.count_if(x).alias(f"n{k}") for k, x in enumerate(whole)))


def word_list(tok: DataFrame, rclasses: Sequence[int], n: int = 1) -> DataFrame:
    """``ngram, freq`` over all books; exactly one class."""
    if len(rclasses) != 1:
        raise NotImplementedError("A word list is of exactly one class")
    return ngrams(tok, rclasses[0], n).groupBy("ngram").agg(F.count(F.lit(1)).alias("freq"))


def clusters(tok: DataFrame, rclass: int, n: int = 1, cutoff: int | None = None, books: int = 2) -> DataFrame:
    """The word list from ``cutoff`` on: by default 5, and 2 where only one book is asked for."""
    return word_list(tok, [rclass], n).where(F.col("freq") >= (cutoff if cutoff is not None else 5 if books > 1 else 2))


def skipped(tok: DataFrame, rclass: int, n: int, cutoff: int) -> DataFrame:
    """One row: how many distinct clusters are below the cutoff."""
    return word_list(tok, [rclass], n).where(F.col("freq") < cutoff).agg(F.count(F.lit(1)).alias("skipped"))

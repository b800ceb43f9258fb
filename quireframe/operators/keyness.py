"""Key words: a target's word list against a reference's by log likelihood."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quireframe.operators.clusters import counts_by_class

#: Critical values of the log likelihood and the p they stand for.
CRITICAL = [(15.13, 0.0001), (10.83, 0.001), (6.63, 0.01), (3.84, 0.05)]


def expected(a: Column, b: Column, ta: Column, tb: Column) -> tuple[Column, Column]:
    """How often a type would occur in either list if both used it alike."""
    both = (a + b).cast("double")
    return ta * both / (ta + tb), tb * both / (ta + tb)


def log_likelihood(a: Column, b: Column, ta: Column, tb: Column) -> Column:
    """The log likelihood of counts ``a`` of ``ta`` and ``b`` of ``tb``; a reference count of 0 adds nothing."""
    ea, eb = expected(a, b, ta, tb)
    own = a * F.log(a / ea)
    return 2 * (own + F.when((b == 0) | (eb == 0), F.lit(0.0)).otherwise(b * F.log(b / eb)))


def keywords(target: DataFrame, reference: DataFrame, p_value: float = 0.0001, exclude_underused: bool = True, cutoff: int = 5, digits: int | None = 2, limit: int | None = None, order_by: str = "freq", half_even: bool = True) -> DataFrame:
    """``type, count_analysis, total_analysis, count_ref, total_ref, expected_analysis, expected_ref, ll, use, p``.

    ``target`` and ``reference`` are word lists ``ngram, freq``. Totals are those of the whole lists; the cutoff is
    the target's. ``p_value`` keeps what reaches its critical value if it is one of 0.05, 0.01, 0.001 and 0.0001, else
    all. Thresholds see unrounded values. ``limit`` keeps the first by target frequency (or by ``order_by='ll'``),
    ties by type. If either list is empty there are no key words.
    """
    t = target.select(F.col("ngram").alias("type"), F.col("freq").alias("count_analysis"))
    r = reference.select(F.col("ngram").alias("type"), F.col("freq").alias("count_ref"))
    totals = (target.agg(F.sum("freq").alias("n")).scalar(), reference.agg(F.sum("freq").alias("n")).scalar())
    both = t.where(F.col("count_analysis") >= cutoff).join(r, "type", "left").withColumn("count_ref", F.coalesce("count_ref", F.lit(0).cast("long")))
    return _scored(both.withColumn("total_analysis", totals[0]).withColumn("total_ref", totals[1]), p_value, exclude_underused, digits, limit, order_by, half_even)


def keywords_within(tok: DataFrame, target: int, reference: int, n: int = 1, p_value: float = 0.0001, exclude_underused: bool = True, cutoff: int = 5, digits: int | None = 2, limit: int | None = None, order_by: str = "freq", half_even: bool = True) -> DataFrame:
    """``keywords`` of one class of the same books against another: both word lists come from one scan of the tokens."""
    lists = counts_by_class(tok, [target, reference], n)
    totals = lists.agg(F.struct(F.sum("n0").alias("a"), F.sum("n1").alias("b")).alias("t")).scalar()
    both = lists.where(F.col("n0") >= max(1, cutoff)).select(F.col("ngram").alias("type"), F.col("n0").alias("count_analysis"), F.col("n1").alias("count_ref"))
    return _scored(both.withColumn("total_analysis", totals["a"]).withColumn("total_ref", totals["b"]), p_value, exclude_underused, digits, limit, order_by, half_even)


def _scored(both: DataFrame, p_value: float, exclude_underused: bool, digits: int | None, limit: int | None, order_by: str, half_even: bool) -> DataFrame:
    both = both.where((F.col("total_analysis") > 0) & (F.col("total_ref") > 0))
    a, b, ta, tb = (F.col(c) for c in ("count_analysis", "count_ref", "total_analysis", "total_ref"))
    ea, eb = expected(a, b, ta, tb)
    rows = both.select("type", a, ta, b, tb, ea.alias("expected_analysis"), eb.alias("expected_ref"), log_likelihood(a, b, ta, tb).alias("ll"))
    rows = rows.withColumn("use", F.when(a > F.col("expected_analysis"), "+").when(a < F.col("expected_analysis"), "-").otherwise("0"))
    label = F.lit(None).cast("double")
    for value, p in reversed(CRITICAL):
        label = F.when(F.col("ll") >= value, F.lit(p)).otherwise(label)
    rows = rows.withColumn("p", label)
    if exclude_underused:
        rows = rows.where("use = '+'")
    least = {p: v for v, p in CRITICAL}.get(p_value)
    if least is not None:
        rows = rows.where(F.col("ll") >= least)
    if limit is not None:
        rows = rows.orderBy(F.desc("ll" if order_by == "ll" else "count_analysis"), "type").limit(limit)
    if digits is not None:
        f = F.bround if half_even else F.round
        rows = rows.withColumns({c: f(c, digits) for c in ("expected_analysis", "expected_ref", "ll")})
    return rows

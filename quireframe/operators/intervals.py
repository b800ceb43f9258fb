"""Half-open ranges of a text: containment, expansion, complement, span, and segments by what covers them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def holds(outer: tuple[Column, Column], inner: tuple[Column, Column]) -> Column:
    """Whether one range contains another."""
    return (inner[0] >= outer[0]) & (inner[1] <= outer[1])


def expanded(start: Column, end: Column, by: int) -> tuple[Column, Column]:
    """A range with ``by`` more on either side."""
    return start - by, end + by


def span(df: DataFrame, keys: Sequence[str], start: str = "r_start", end: str = "r_end") -> DataFrame:
    """The range from the first start to the last end of every group."""
    return df.groupBy(*keys).agg(F.min(start).alias(start), F.max(end).alias(end))


def ordered(df: DataFrame, start: str = "r_start", end: str = "r_end") -> DataFrame:
    """Rows by start, the wider range first, then class."""
    return df.orderBy(start, F.desc(end), "rclass_id")


def complement(df: DataFrame, keys: Sequence[str], lengths: DataFrame | None = None, start: str = "r_start", end: str = "r_end") -> DataFrame:
    """The gaps between the ranges of a group in their order; with ``lengths`` (keys, length) also before and after.

    Ranges may nest and overlap: a gap begins where all ranges before have ended. Groups that are in ``lengths`` only
    are one gap.
    """
    w = Window.partitionBy(*keys).orderBy(start, end)
    rows = df.select(*keys, start, end)
    if lengths is not None:
        rows = rows.unionByName(lengths.select(*keys, F.col("length").alias(start), F.col("length").alias(end)))
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    gaps = rows.select(*keys, (F.coalesce(before, F.lit(0)) if lengths is not None else before).alias("g_start"), F.col(start).alias("g_end"))
    return gaps.where("g_start < g_end").withColumnsRenamed({"g_start": start, "g_end": end})


def trimmed(df: DataFrame, content: str, start: str = "r_start", end: str = "r_end") -> DataFrame:
    """Ranges without the white space at their edges; what is blank goes."""
    t = F.substring(content, F.col(start) + 1, F.col(end) - F.col(start))
    lead = F.length(t) - F.length(F.regexp_replace(t, "^[\\s\\p{Z}]+", ""))
    trail = F.length(t) - F.length(F.regexp_replace(t, "[\\s\\p{Z}]+$", ""))
    return df.withColumns({start: F.col(start) + lead, end: F.col(end) - trail}).where(F.col(start) < F.col(end))


def segments(df: DataFrame, key: str, label: str, start: str = "r_start", end: str = "r_end") -> DataFrame:
    """Overlapping ranges as disjoint segments between cut points, each with the sorted set of labels that cover it.

    A sweep over the boundaries: labels open and close at points; a label is on while more of its ranges have opened
    than closed. Stretches that nothing covers are left out.
    """
    points = df.where(F.col(start) < F.col(end)).select(key, F.explode(F.array(F.struct(F.col(start).alias("at"), F.col(label).alias("l"), F.lit(1).alias("d")), F.struct(F.col(end).alias("at"), F.col(label).alias("l"), F.lit(-1).alias("d")))).alias("x")).select(key, "x.*")
    turns = points.groupBy(key, "l", "at").agg(F.sum("d").alias("d"))
    w = Window.partitionBy(key, "l").orderBy("at")
    on = turns.withColumn("open", F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("until", F.lead("at").over(w)).where("open > 0").select(key, "l", F.col("at").alias("a"), F.col("until").alias("z"))
    cuts = points.select(key, "at").distinct()
    pieces = cuts.select(key, F.col("at").alias("s"), F.lead("at").over(Window.partitionBy(key).orderBy("at")).alias("e")).where("e is not null")
    n = 1024
    left = pieces.withColumn("bin_", F.floor(F.col("s") / n))
    right = on.withColumn("bin_", F.explode(F.sequence(F.floor(F.col("a") / n), F.floor((F.col("z") - 1) / n)))).withColumnRenamed(key, "k_").withColumnRenamed("bin_", "b_")
    met = left.join(right, (F.col(key) == F.col("k_")) & (F.col("bin_") == F.col("b_")) & (F.col("a") <= F.col("s")) & (F.col("e") <= F.col("z")))
    return met.groupBy(key, F.col("s").alias(start), F.col("e").alias(end)).agg(F.array_sort(F.collect_set("l")).alias("labels"))

"""Every region of a subset with its tokens and what surrounds it, and token counts by subset."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireframe.errors import UserError
from quireframe.operators.store import BIN, in_class, value_of


def listing(tok: DataFrame, reg: DataFrame, rclasses: Sequence[int], context: int = 0) -> DataFrame:
    """``book_id, rclass_id, start, end, left, node, right, chapter, paragraph, sentence`` per region with a token.

    Repeated rows count once. The node is the tokens within the region, the windows those within ``context * 10`` characters of it; start and
    end are the region's. Chapter, paragraph and sentence come from the first token of all windows, -1 for none.
    """
    if not rclasses:
        raise UserError("You must supply a subset")
    wide = context * 10
    want = reg.where(F.col("rclass_id").isin(list(rclasses))).select(F.col("book_id").alias("b"), "rclass_id", "r_start", "r_end", (F.col("r_start") - wide).alias("x_start"), (F.col("r_end") + wide).alias("x_end"))
    # A long region is looked up bin by bin; a token stands in the bin it begins in, so each pair meets once.
    want = want.withColumn("bin_", F.explode(F.sequence(F.floor(F.greatest(F.col("x_start"), F.lit(0)) / BIN), F.floor(F.col("x_end") / BIN))))
    rows = tok.select("book_id", "tok_start", "tok_end", "ttype", "part_of").withColumn("bin2_", F.floor(F.col("tok_start") / BIN))
    met = want.join(rows, (F.col("b") == F.col("book_id")) & (F.col("bin_") == F.col("bin2_")) & (F.col("tok_start") >= F.col("x_start")) & (F.col("tok_end") <= F.col("x_end")))
    place = F.when(F.col("tok_start") < F.col("r_start"), 0).when(F.col("tok_end") <= F.col("r_end"), 1).otherwise(2)
    token = F.struct("tok_start", "tok_end", "ttype", place.alias("side"), value_of(301).alias("chapter"), value_of(401).alias("paragraph"), value_of(402).alias("sentence"))
    lines = met.groupBy("book_id", "rclass_id", "r_start", "r_end").agg(F.array_sort(F.collect_set(token)).alias("all"))

    def part(k: int):
        return F.transform(F.filter("all", lambda x: x["side"] == k), lambda x: F.struct(x["ttype"].alias("ttype"), x["tok_start"].alias("tok_start"), x["tok_end"].alias("tok_end")))

    out = lines.select("book_id", "rclass_id", F.col("r_start").alias("start"), F.col("r_end").alias("end"), part(0).alias("left"), part(1).alias("node"), part(2).alias("right"), *(F.get("all", F.lit(0))[c].alias(c) for c in ("chapter", "paragraph", "sentence")))
    return out.where(F.size("node") > 0)


def counts(tok: DataFrame, classes: dict[str, int]) -> DataFrame:
    """Per book with a token: how many tokens each subset has, in one pass. Repeated rows count once."""
    flags = tok.select("book_id", "tok_start", *(in_class(c).alias(name) for name, c in classes.items())).distinct()
    return flags.groupBy("book_id").agg(*(F.count_if(F.col(f"`{name}`")).alias(name) for name in classes))

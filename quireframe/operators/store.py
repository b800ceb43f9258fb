"""The annotated store: clean tokens and regions, and the tables derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters per bin of a range join, and tokens per block of a window over a book.
BIN, BLOCK = 4096, 1 << 16
#: Characters of a book that are numbered in one task.
STRETCH = 1 << 18


def tokens(df: DataFrame) -> DataFrame:
    """One row per (book_id, tok_start); of repeated rows any, as they are copies."""
    return df.select("book_id", "tok_start", "tok_end", "ttype", "ordering", "part_of").dropDuplicates(["book_id", "tok_start"])


def regions(df: DataFrame) -> DataFrame:
    """One row per range of a book and class; ranges without characters are left out, of several values the largest stands."""
    return df.where("r_end > r_start").groupBy("book_id", "rclass_id", "r_start", "r_end").agg(F.max("rvalue").alias("rvalue"))


def in_class(rclass: int, part_of: Column | str = "part_of") -> Column:
    """Whether a token is part of a region of ``rclass``; false where it is part of none."""
    return F.coalesce(F.map_contains_key(part_of, F.lit(rclass)), F.lit(False))


def value_of(rclass: int, part_of: Column | str = "part_of", default: int = -1) -> Column:
    """The value of the region of ``rclass`` that a token is part of."""
    return F.coalesce(F.try_element_at(part_of, F.lit(rclass)), F.lit(default))


def numbered(tok: DataFrame) -> DataFrame:
    """``ordering``: the 1-based position of every token within its book, by range.

    Tokens are counted by book and stretch of characters, the counts summed up over the stretches of a book, and tokens
    numbered within theirs: a very long book is spread over as many tasks as it has stretches.
    """
    rows = tok.withColumn("bin_", F.floor(F.col("tok_start") / STRETCH))
    sums = rows.groupBy("book_id", "bin_").agg(F.count(F.lit(1)).alias("n_"))
    before = Window.partitionBy("book_id").orderBy("bin_").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("book_id", "bin_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("off_"))
    here = F.row_number().over(Window.partitionBy("book_id", "bin_").orderBy("tok_start", "tok_end"))
    return rows.withColumn("here_", here).join(offsets, ["book_id", "bin_"]).withColumn("ordering", (F.col("here_") + F.col("off_")).cast("int")).drop("bin_", "here_", "off_")


def blocked(df: DataFrame, position: str, before: int, after: int, block: int = BLOCK) -> DataFrame:
    """Rows with ``blk``, ``own``: each in its block of positions, and again in neighbouring blocks whose windows reach it.

    A window over (book_id, blk) of up to ``before`` rows back and ``after`` on then sees what one over the book would,
    for the rows with ``own``; a very long book is spread over many tasks. Positions must be dense.
    """
    home = F.floor(F.col(position) / block).cast("int")
    first, last = F.floor((F.col(position) - after) / block).cast("int"), F.floor((F.col(position) + before) / block).cast("int")
    return df.withColumn("blk", F.explode(F.sequence(first, last))).withColumn("own", F.col("blk") == home)


def contained(inner: DataFrame, outer: DataFrame, inner_range: tuple[str, str], outer_range: tuple[str, str], how: str = "inner") -> DataFrame:
    """Rows of ``inner`` with the rows of ``outer`` of the same book whose range holds theirs, by binned equality.

    ``outer`` must have no column of ``inner`` but ``book_id``. A left join is kept to the inner rows.
    """
    a, b = inner_range
    s, e = outer_range
    left = inner.withColumn("bin_", F.floor(F.col(a) / BIN))
    right = outer.withColumn("bin_", F.explode(F.sequence(F.floor(F.col(s) / BIN), F.floor((F.greatest(F.col(e), F.col(s) + 1) - 1) / BIN)))).withColumnRenamed("book_id", "book_").withColumnRenamed("bin_", "bin2_")
    on = (F.col("book_id") == F.col("book_")) & (F.col("bin_") == F.col("bin2_")) & (F.col(a) >= F.col(s)) & (F.col(b) <= F.col(e))
    return left.join(right, on, how).drop("book_", "bin_", "bin2_")


def with_part_of(tok: DataFrame, reg: DataFrame) -> DataFrame:
    """``part_of`` of every token from the regions that hold it: class to (largest) value, null where there is none.

    Tokens and regions meet once, and what a token meets is gathered with the token itself; repeated rows of a token,
    which are copies, count once.
    """
    own = [c for c in tok.columns if c not in ("book_id", "tok_start", "part_of")]
    held = contained(tok.select("book_id", "tok_start", *own), reg.select("book_id", "rclass_id", "r_start", "r_end", "rvalue"), ("tok_start", "tok_end"), ("r_start", "r_end"), "left")
    met = F.collect_set(F.when(F.col("rclass_id").isNotNull(), F.struct("rclass_id", "rvalue")))  # as many as there are classes
    rows = held.groupBy("book_id", "tok_start").agg(*(F.first(c).alias(c) for c in own), met.alias("met"))
    value = lambda k: F.array_max(F.transform(F.filter("met", lambda x: x["rclass_id"] == k), lambda x: x["rvalue"]))
    classes = F.array_distinct(F.transform("met", lambda x: x["rclass_id"]))
    part_of = F.when(F.size("met") > 0, F.map_from_arrays(classes, F.transform(classes, value)))
    return rows.select("book_id", "tok_start", *own, part_of.alias("part_of"))


def word_counts(tok: DataFrame, reg: DataFrame, classes: list[int] | None = None) -> DataFrame:
    """``word_count`` per region: the tokens with a type that it holds, 0 where there is none; repeated tokens count once."""
    rows = reg.where(F.col("rclass_id").isin(classes)) if classes else reg
    inner = tok.where(F.col("ttype").isNotNull()).select("book_id", "tok_start", "tok_end").distinct()
    held = contained(inner, rows.select("book_id", "rclass_id", "r_start", "r_end"), ("tok_start", "tok_end"), ("r_start", "r_end"))
    counted = held.groupBy("book_id", "rclass_id", "r_start", "r_end").agg(F.count(F.lit(1)).alias("word_count"))
    keys = ["book_id", "rclass_id", "r_start", "r_end"]
    return rows.join(counted, keys, "left").withColumn("word_count", F.coalesce("word_count", F.lit(0).cast("long")))


def chunks(book: DataFrame) -> DataFrame:
    """``book_id, chunk, piece``: contents in pieces of ``BIN`` characters, found in one pass over each."""
    pieces = F.regexp_extract_all("content", F.lit(f"(?s).{{1,{BIN}}}"), F.lit(0))
    return book.where("content != ''").select("book_id", F.posexplode(pieces).alias("chunk", "piece"))


def with_substring(rows: DataFrame, book: DataFrame, start: str, end: str, name: str) -> DataFrame:
    """``rows`` of books with a content, with the text of their ranges as ``name``; an empty range has an empty text.

    Ranges meet the pieces of the content that they touch, so that no row is ever joined to a whole book.
    """
    ranges = rows.where(F.col(end) > F.col(start)).select("book_id", F.col(start).alias("a_"), F.col(end).alias("z_")).distinct()
    touched = ranges.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("a_") / BIN).cast("int"), F.floor((F.col("z_") - 1) / BIN).cast("int"))))
    met = touched.join(chunks(book), ["book_id", "chunk"]).groupBy("book_id", "a_", "z_").agg(F.array_sort(F.collect_list(F.struct("chunk", "piece"))).alias("p_"))
    whole = F.array_join(F.transform("p_", lambda x: x["piece"]), "")
    offset = F.floor(F.col("a_") / BIN).cast("int") * BIN
    texts = met.select("book_id", "a_", "z_", F.substring(whole, F.col("a_") - offset + 1, F.col("z_") - F.col("a_")).alias(name))
    have = rows.join(book.where("content is not null").select("book_id"), "book_id", "left_semi").withColumns({"a_": F.col(start), "z_": F.col(end)})
    return have.join(texts, ["book_id", "a_", "z_"], "left").withColumn(name, F.coalesce(name, F.lit(""))).drop("a_", "z_")


def region_text(book: DataFrame, reg: DataFrame, classes: list[int]) -> DataFrame:
    """``content``: the text of every region of ``classes``; null where the book has none."""
    rows = reg.where(F.col("rclass_id").isin(classes)).select("book_id", "rclass_id", "rvalue", "r_start", "r_end")
    bare = rows.join(book.where("content is null").select("book_id"), "book_id", "left_semi").withColumn("content", F.lit(None).cast("string"))
    return with_substring(rows, book, "r_start", "r_end", "content").unionByName(bare).select("book_id", "rclass_id", "rvalue", "r_start", "content")

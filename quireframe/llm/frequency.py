"""How often every distinct value occurs, and in how many records; marks for values too rare or too common."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

#: Positions of a record that are counted together.
BLOCK = 1 << 15


def value_frequencies(df: DataFrame, value: str, record: str, position: str | None = None, block: int = BLOCK) -> DataFrame:
    """``value, occurrences, records``: over all rows, or over distinct (record, position) if a position is given.

    A null value is left out, a null record or position counts as a value of its own. Characters count as they stand.
    An empty table gives no rows; other columns are ignored. Of several different values at one position each counts.

    Counts of a record's values are made where its rows are read, each with the set of positions it was made from, as
    repeated rows may lie in other partitions; these meet by (value, record) and then by value, each time combined
    before the shuffle. Positions are integers. A record is divided after every ``block`` positions (at most 32,768, so
    that two bytes tell a place), so no task holds more positions of a value than one block has; what lies in later
    blocks takes a shuffle of its own, of those rows alone.
    """
    if not 0 < block <= BLOCK:
        raise ValueError(f"A block has 1 to {BLOCK} positions")
    kind = df.schema[record].dataType
    of = F.col(record) if isinstance(kind, (NumericType, StringType)) else F.col(record).cast("string")
    # A null record is told by a flag, so that records can be joined on.
    rows = df.where(F.col(value).isNotNull()).select(F.coalesce(of, F.lit("0").cast(kind) if isinstance(kind, NumericType) else F.lit("")).alias("r"), F.col(record).isNull().alias("no"), F.col(value).alias("v"), *([F.col(position).alias("p"), F.expr(f"cast(coalesce(pmod(`{position}`, {block}), -1) as smallint)").alias("q")] if position else []))
    if position is None:
        per_record = rows.groupBy("v", "r", "no").agg(F.count(F.lit(1)).alias("n"))
    else:
        first = _counted(rows.where(f"p is null or p between 0 and {block - 1}"), F.lit(0))
        later = _counted(rows.where(f"p < 0 or p >= {block}"), F.expr(f"floor(p / {block})")).groupBy("v", "r", "no").agg(F.sum("n").alias("m"))
        # Both are divided by (value, record) already, so they meet without another shuffle.
        per_record = first.join(later.hint("shuffle_hash"), ["v", "r", "no"], "full").select("v", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"))
    return per_record.groupBy("v").agg(F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("records")).withColumnRenamed("v", value)


def _counted(rows: DataFrame, block: Column) -> DataFrame:
    """``v, r, n``: distinct positions of a value in a record, for each block of them."""
    sets = rows.groupBy("v", "r", "no", block.alias("b")).agg(F.collect_set("q").alias("s"))
    return sets.select("v", "r", "no", F.size("s").cast("long").alias("n"))


def mark_extremes(freq: DataFrame, records: int | DataFrame, min_occurrences: int = 3, max_share: float = 0.5) -> DataFrame:
    """``freq`` with ``mark``: 'rare' below ``min_occurrences``, 'common' in more than ``max_share`` of ``records``, else null.

    ``records`` is a number or a table of one row and column. A value that is both counts as rare.
    """
    total = F.lit(records) if isinstance(records, int) else records.scalar()
    return freq.withColumn("mark", F.when(F.col("occurrences") < min_occurrences, "rare").when(F.col("records") > max_share * total, "common"))

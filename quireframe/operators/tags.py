"""Tags that readers put on result lines: ``tag, pos, row_id`` rows, one for each tagged line, and the tags themselves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unique_name(name: str, taken: Sequence[str]) -> str:
    """``name``, made to begin with a letter and to differ from ``taken`` by a number after it."""
    base = f"n{name}" if name.isdigit() else name
    out, i = base, 0
    while out in taken:
        i += 1
        out = f"{base}-{i}"
    return out


def add_columns(lines: DataFrame, tags: DataFrame, names: Sequence[str], row_id: str = "row_id") -> DataFrame:
    """``lines`` with a boolean column ``tag:NAME`` for each tag."""
    held = tags.select(F.col(row_id), "tag").distinct().groupBy(row_id).agg(*(F.max(F.col("tag") == n).alias(f"tag:{n}") for n in names))
    return lines.join(held, row_id, "left").fillna(False, subset=[f"tag:{n}" for n in names])


def to_rows(wide: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Columns ``tag:NAME`` of a saved table as ``tag, row_id`` rows; a cell that is empty, false or n tags nothing."""
    names = [c for c in wide.columns if c.startswith("tag:")]
    if not names:
        return wide.select(F.lit("").alias("tag"), F.col(row_id)).limit(0)
    pairs = F.array(*(F.struct(F.lit(n.removeprefix("tag:")).alias("tag"), F.col(f"`{n}`").cast("string").alias("v")) for n in names))
    return wide.select(row_id, F.explode(pairs).alias("x")).where(~F.lower(F.coalesce("x.v", F.lit(""))).isin("", "false", "n", "no", "0")).select("x.tag", row_id)


def merge(own: DataFrame, other: DataFrame, order: Sequence[str], others: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Two sets of tags in one: those of ``other`` that clash get a number; the names in their new order."""
    names, new = list(order), {}
    for n in others:
        new[n] = unique_name(n, names)
        names.append(new[n])
    renamed = other
    clash = {k: v for k, v in new.items() if k != v}
    if clash:
        pairs = F.create_map(*(F.lit(x) for kv in clash.items() for x in kv))
        renamed = other.withColumn("tag", F.coalesce(F.try_element_at(pairs, F.col("tag")), F.col("tag")))
    return own.select("tag", "row_id").unionByName(renamed.select("tag", "row_id")), names


def rename(tags: DataFrame, old: str, new: str) -> DataFrame:
    return tags.withColumn("tag", F.when(F.col("tag") == old, new).otherwise(F.col("tag")))


def drop(tags: DataFrame, name: str) -> DataFrame:
    return tags.where(F.col("tag") != name)


def toggle(tags: DataFrame, selection: DataFrame, name: str, on: bool) -> DataFrame:
    """The tag put on (or taken off) all selected rows."""
    mine = (F.col("tag") == name).alias("mine")
    rest = tags.join(selection.select("row_id").distinct().withColumn("hit", F.lit(True)), "row_id", "left").where(~(F.coalesce("hit", F.lit(False)) & mine)).select("tag", "row_id")
    return rest.unionByName(selection.select(F.lit(name).alias("tag"), "row_id").distinct()) if on else rest


def states(tags: DataFrame, selection: DataFrame, names: Sequence[str]) -> DataFrame:
    """``tag, state`` over the selected rows: 'yes' if all have it, 'no' if none, else 'mix', also for no selection."""
    wide = add_columns(selection.select("row_id").distinct(), tags, names)
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("tag"), F.col(f"`tag:{n}`").alias("v")) for n in names))).alias("x")
    got = wide.select(each).groupBy("x.tag").agg(F.min("x.v").alias("a"), F.max("x.v").alias("b")).select("tag", F.when(F.col("a"), "yes").when(~F.col("b"), "no").otherwise("mix").alias("state"))
    every = selection.sparkSession.createDataFrame([(n,) for n in names], "tag string")
    return every.join(got, "tag", "left").select("tag", F.coalesce("state", F.lit("mix")).alias("state"))

"""The most frequent values of a column in bounded memory.

Every task keeps a space-saving summary of ``capacity`` counters over the rows it sees; summaries merge in a tree. A
value's true count lies between ``count - error`` and ``count``, and a value that no summary holds has at most
``rows / capacity`` rows, so no value above that share is missed. A second scan counts the survivors exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SUMMARY = "node int, v string, n long, err long, floor long, total long"


def merge(parts: list[pd.DataFrame], capacity: int) -> pd.DataFrame:
    """One summary of several: a value that a summary lacks may have had its smallest count (floor) there."""
    floors = sum(int(p["floor"].iloc[0]) for p in parts)
    every = pd.concat([p.assign(d=p["n"] - p["floor"], e=p["err"] - p["floor"]) for p in parts])
    m = every.groupby("v", sort=False, as_index=False)[["d", "e"]].sum()
    out = pd.DataFrame({"v": m["v"], "n": m["d"] + floors, "err": m["e"] + floors})
    total = sum(int(p["total"].iloc[0]) for p in parts)
    floor = floors
    if len(out) > capacity:
        out = out.sort_values(["n", "v"], ascending=[False, True])
        floor = int(out["n"].iloc[capacity])  # nothing dropped can have more
        out = out.iloc[:capacity]
    return out.assign(floor=max(floor, floors), total=total)


def _counted(values: pa.ChunkedArray | pa.Array) -> pd.DataFrame | None:
    c = pc.value_counts(values)
    v = c.field("values")
    if not len(v):
        return None
    n = c.field("counts").to_numpy(zero_copy_only=False).astype(np.int64)
    return pd.DataFrame({"v": v.to_pandas(), "n": n, "err": np.zeros(len(n), np.int64), "floor": 0, "total": int(n.sum())})


def _summaries(capacity: int, rows: int = 200_000):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary: pd.DataFrame | None = None
        node, held, some = 0, 0, []

        def take() -> None:
            nonlocal summary, held, some
            now = _counted(pa.chunked_array(some)) if some else None
            held, some = 0, []
            if now is not None:
                summary = merge([now] if summary is None else [summary, now], capacity)

        for b in batches:
            if b.num_rows:
                node = b.column(0)[0].as_py()
                some.append(b.column(1))
                held += b.num_rows
                if held >= rows:
                    take()
        take()
        if summary is not None:
            yield pa.RecordBatch.from_pandas(summary.assign(node=np.int32(node))[["node", "v", "n", "err", "floor", "total"]], preserve_index=False)

    return scan


def summarise(df: DataFrame, value: str, capacity: int = 4096, fan_in: int = 16) -> DataFrame:
    """One summary of the non-null values: ``v, n, err, floor, total``. Values are compared as strings, as they stand."""
    rows = df.where(F.col(value).isNotNull()).select(F.spark_partition_id().alias("node"), F.col(value).cast("string").alias("v"))
    nodes = max(1, rows.rdd.getNumPartitions())
    level = rows.mapInArrow(_summaries(capacity), SUMMARY)

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [p for _, p in pdf.groupby("sub")]
        return merge(parts, capacity).assign(node=pdf["node"].iloc[0])[["node", "v", "n", "err", "floor", "total"]]

    while True:
        # The last level takes all that are left, should the run have had more partitions than the plan showed.
        up = F.lit(0) if nodes <= fan_in else F.expr(f"node div {fan_in}").cast("int")
        level = level.withColumn("sub", F.col("node")).withColumn("node", up).groupBy("node").applyInPandas(join, SUMMARY)
        if nodes <= fan_in:
            break
        nodes = -(-nodes // fan_in)
    return level.drop("node")


def heavy_hitters(df: DataFrame, value: str, share: float, capacity: int = 4096, fan_in: int = 16) -> DataFrame:
    """``value, n, estimate, error``: every value that fills at least ``share`` of the rows with a value, counted exactly.

    Needs ``capacity > 1 / share``. Nulls are left out, repeated rows count as they stand, an empty table gives no
    rows, other columns are ignored. Memory: ``capacity`` counters a task, ``fan_in`` summaries in a merge; the
    candidates sent to all tasks are at most ``1 / share`` times the summary's slack and never more than ``capacity``.
    """
    if capacity * share <= 1:
        raise ValueError("capacity must exceed 1 / share")
    top = summarise(df, value, capacity, fan_in).where(F.col("n") >= share * F.col("total")).select("v", F.col("n").alias("estimate"), F.col("err").alias("error"), "total")
    rows = df.select(F.col(value).cast("string").alias("v"))
    exact = rows.join(F.broadcast(top), "v").groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.max("estimate").alias("estimate"), F.max("error").alias("error"), F.max("total").alias("total"))
    return exact.where(F.col("n") >= share * F.col("total")).select(F.col("v").alias(value), "n", "estimate", "error")

"""Overlapping, nested and gapped intervals: continuous periods per entity and the gaps between them.

The rows are range-sorted over the whole cluster by entity and start, so an entity that holds a third of all rows is
spread over many tasks. Each partition is summarised by the greatest (entity, end) it holds; as the order is global, the
running maximum of these summaries is the state that a partition takes over from all before it: the entity that is open
and how far it is covered. A look at the beginning of each partition with that state tells how far the period taken over
goes on in it; combined from behind, this tells where the period that a partition leaves open will end. The last scan has
all it needs to label and emit its periods by itself. Summaries are a row per partition, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireframe.session import cut, parallelism


class State(NamedTuple):
    """An entity (its columns), how far it is covered, and where its open period began; None if in an earlier partition."""

    entity: tuple
    covered: int
    begun: int | None


class Block(NamedTuple):
    """A batch in sort order: where an entity or a period begins, and how far is covered before and after each row."""

    keys: list[tuple[np.ndarray, np.ndarray]]
    start: np.ndarray
    new: np.ndarray
    fresh: np.ndarray
    before: np.ndarray
    reach: np.ndarray

    def entity(self, row: int) -> tuple:
        return tuple(None if null[row] else int(value[row]) for value, null in self.keys)


def running_maximum(values: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The maximum so far of each group; ``group`` counts up from 0 or 1."""
    low = int(values.min())
    width = int(values.max()) - low + 1
    if width * (int(group[-1]) + 1) < 1 << 62:
        lift = group * np.int64(width)
        return np.maximum.accumulate(values - low + lift) - lift + low
    return np.concatenate([np.maximum.accumulate(x) for x in np.split(values, np.flatnonzero(np.diff(group)) + 1)])


def block_of(batch: pa.RecordBatch, keys: int, state: State | None) -> Block:
    """What ``batch`` (k0.., s, e) holds, after all that ``state`` stands for."""
    columns = [(batch.column(i).fill_null(0).to_numpy(zero_copy_only=False), batch.column(i).is_null().to_numpy(zero_copy_only=False)) for i in range(keys)]
    s, e = (batch.column(keys + i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
    new = np.zeros(len(s), dtype=bool)
    for value, null in columns:
        new[1:] |= (value[1:] != value[:-1]) | (null[1:] != null[:-1])
    goes_on = state is not None and Block(columns, s, new, new, s, e).entity(0) == state.entity
    new[0] = not goes_on
    if goes_on:
        e = e.copy()
        e[0] = max(int(e[0]), state.covered)
    reach = running_maximum(e, np.cumsum(new))
    before = np.empty_like(reach)
    before[1:] = reach[:-1]
    before[0] = state.covered if goes_on else 0
    return Block(columns, s, new, new | (s > before), before, reach)


def _beginnings(keys: int, taken: dict[int, State]):
    """For each partition how far the period that it takes over goes on in it, and whether that is all it holds."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId()
        state, end, ended = taken.get(at), None, False
        for batch in batches:
            if ended or not batch.num_rows:
                continue
            block = block_of(batch, keys, state)
            stop = np.flatnonzero(block.fresh)
            n = int(stop[0]) if len(stop) else batch.num_rows
            ended = len(stop) > 0
            if n:
                end = int(block.reach[n - 1])
                state = State(state.entity, end, None)
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([end], pa.int64()), pa.array([not ended])], names=["p", "end", "whole"])

    return scan


def _spans(keys: int, taken: dict[int, State], ends: dict[int, int]):
    """Sorted ranges to periods (g false) and gaps (g true) of the entities: k0.., a, z, g."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId()
        state = taken.get(at)

        def rows(entities: list[pa.Array], a, z, gap: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*entities, pa.array(a, pa.int64()), pa.array(z, pa.int64()), pa.array(np.full(len(a), gap))], names=[*(f"k{i}" for i in range(keys)), "a", "z", "g"])

        def one(x: State, end: int) -> pa.RecordBatch:
            return rows([pa.array([k], pa.int64()) for k in x.entity], [x.begun], [end], False)

        for batch in batches:
            if not batch.num_rows:
                continue
            block = block_of(batch, keys, state)
            begin = np.flatnonzero(block.fresh)
            first = int(begin[0]) if len(begin) else batch.num_rows
            if state is not None and first:
                state = state._replace(covered=int(block.reach[first - 1]))
            if not len(begin):
                continue
            if state is not None and state.begun is not None:
                yield one(state, state.covered)
            of = lambda idx: [pa.array(value[idx].astype(np.int64), mask=null[idx]) for value, null in block.keys]  # noqa: B023, E731
            closed = begin[:-1]
            if len(closed):
                yield rows(of(closed), block.start[closed], block.reach[begin[1:] - 1], False)
            hole = begin[~block.new[begin]]
            if len(hole):
                yield rows(of(hole), block.before[hole], block.start[hole], True)
            last = int(begin[-1])
            state = State(block.entity(last), int(block.reach[-1]), int(block.start[last]))
        if state is not None and state.begun is not None:
            yield one(state, max(state.covered, ends.get(at, state.covered)))

    return scan


def _after(x: tuple) -> tuple:
    """Order of entities: nulls first."""
    return tuple((v is not None, v or 0) for v in x)


def taken_over(summaries: dict[int, tuple[tuple, int]], partitions: int) -> dict[int, State]:
    """What each partition takes over: the greatest (entity, end) of all before it."""
    out: dict[int, State] = {}
    most: tuple[tuple, int] | None = None
    for p in range(partitions):
        if most is not None:
            out[p] = State(most[0], most[1], None)
        if p in summaries and (most is None or (_after(summaries[p][0]), summaries[p][1]) > (_after(most[0]), most[1])):
            most = summaries[p]
    return out


def left_open(beginnings: dict[int, tuple[int | None, bool]], partitions: int) -> dict[int, int]:
    """Where the period that each partition leaves open ends, if it goes on in later ones."""
    out: dict[int, int] = {}
    beyond: int | None = None
    for p in range(partitions - 1, -1, -1):
        if beyond is not None:
            out[p] = beyond
        end, whole = beginnings.get(p, (None, True))
        further = beyond if whole else None
        beyond = max((x for x in (end, further) if x is not None), default=None)
    return out


def periods_and_gaps(df: DataFrame, entity: Sequence[str], start: str, end: str, partitions: int | None = None) -> DataFrame:
    """One row per period and gap: the entity columns, ``kind`` ('period' or 'gap'), ``span_start``, ``span_end``.

    ``entity`` are integer columns, ``start`` and ``end`` integers, half open. Ranges that touch belong together.
    A range without extent (an end that is null or not after the start, or a null start) is left out. Nulls in the
    entity columns form an entity of their own. Repeated rows and ties change nothing; an empty table gives no rows;
    further columns are ignored, whatever their names.
    """
    spark, keys = df.sparkSession, [f"k{i}" for i in range(len(entity))]
    kinds = [df.schema[c].dataType for c in entity]
    back = df.schema[start].dataType
    ranges = (
        df.select(*(F.col(c).cast("long").alias(k) for c, k in zip(entity, keys, strict=True)), F.col(start).cast("long").alias("s"), F.col(end).cast("long").alias("e"))
        .where("e > s")
        .groupBy(*keys, "s")
        .agg(F.max("e").alias("e"))
    )
    order = [F.col(c) for c in [*keys, "s"]]
    ranges = cut(ranges.repartitionByRange(partitions or parallelism(spark), *order).sortWithinPartitions(*order))
    width = ranges.rdd.getNumPartitions()
    tops = ranges.groupBy(F.spark_partition_id().alias("p")).agg(F.max(F.struct(*keys, "e")).alias("m")).collect()  # a row per partition
    taken = taken_over({r["p"]: (tuple(r["m"])[:-1], r["m"]["e"]) for r in tops}, width)
    seen = ranges.mapInArrow(_beginnings(len(keys), taken), "p int, end long, whole boolean").collect()  # a row per partition
    ends = left_open({r["p"]: (r["end"], r["whole"]) for r in seen}, width)
    spans = ranges.mapInArrow(_spans(len(keys), taken, ends), ", ".join([*(f"{k} long" for k in keys), "a long", "z long", "g boolean"]))
    return spans.select(*(F.col(k).cast(t).alias(c) for k, c, t in zip(keys, entity, kinds, strict=True)), F.when(F.col("g"), "gap").otherwise("period").alias("kind"), F.col("a").cast(back).alias("span_start"), F.col("z").cast(back).alias("span_end"))

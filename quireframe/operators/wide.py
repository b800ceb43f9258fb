"""Entity, attribute, value rows as one row per entity with typed columns, by characteristic sets.

Entities that have exactly the same attributes form a characteristic set. Each set is a dense table of its own, a
directory in the shared folder that holds a column for each attribute of the set, in their order, and nothing for the
others. Tables with equally many columns have one layout and are read together; the layouts, of which there is one more
than attributes, are then united by name, where a column that a set lacks is missing. So the plan has as many branches
however many sets there are, and none is treated unlike another.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quireframe.session import ensure_checkpoint_dir, parallelism


class Attribute(NamedTuple):
    """A column of the wide table: its name, how a value is read (null: it denotes none) and its type."""

    name: str
    read: Callable[[Column], Column]
    kind: str


def to_wide(df: DataFrame, entity: str, attribute: str, value: str, loaded: str, attributes: Mapping[int, Attribute]) -> DataFrame:
    """One row per non-null entity: ``entity`` and a typed column for each of ``attributes``.

    Of several rows for a cell the one loaded last counts whose value denotes something; equal loading times are
    decided by the greater value, a null time is before all others. Rows of other (or null) attributes only make sure
    that their entity has a row. Repeated rows change nothing; an empty table gives no rows; other columns are ignored.
    """
    spark = df.sparkSession
    spec = [(k, f"c{i}", a) for i, (k, a) in enumerate(attributes.items())]
    rows = df.where(F.col(entity).isNotNull()).select(F.col(entity).alias("e"), F.col(attribute).alias("a"), F.col(value).cast("string").alias("v"), F.col(loaded).alias("t"))

    def cell(v: Column) -> Column:
        return reduce(lambda c, s: c.when(F.col("a") == s[0], s[2].read(v).cast("string")), spec, F.when(F.lit(False), F.lit("")))

    # The lambda keeps this long expression out of the generated code, the explode out of every aggregate.
    read = rows.select("e", "a", "t", F.explode(F.transform(F.array("v"), cell)).alias("x"))
    last = read.groupBy("e").agg(*(F.max(F.when((F.col("a") == k) & F.col("x").isNotNull(), F.struct("t", "x"))).alias(c) for k, c, _ in spec))
    cells = last.select("e", *(F.col(c)["x"].alias(c) for _, c, _ in spec))
    values = F.array_compact(F.array(*(c for _, c, _ in spec)))
    bits = F.concat(*(F.when(F.col(c).isNull(), "0").otherwise("1") for _, c, _ in spec))
    dense = cells.select("e", values.alias("x"), F.size(values).alias("n"), F.concat(F.lit("s"), bits).alias("sig")).select("e", "n", "sig", *(F.get("x", F.lit(i)).alias(f"x{i}") for i in range(len(spec))))

    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/wide-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    # By range, small sets share a task and one that holds a third of all entities is divided over several.
    dense.repartitionByRange(parallelism(spark), "n", "sig", "e").write.partitionBy("n", "sig").parquet(path)
    stored = spark.read.schema(dense.schema).parquet(path)

    def layout(n: int) -> DataFrame:
        """The tables with ``n`` columns: each attribute of a set stands as far in as the set has attributes before it."""
        rows = stored.where(f"n = {n}")
        own = F.array(*(f"x{i}" for i in range(n)))
        names = []
        for i, (_, _, a) in enumerate(spec):
            before = F.length(F.replace(F.substring("sig", 2, i), F.lit("0"), F.lit("")))
            names.append(F.when(F.substring("sig", i + 2, 1) == "1", F.get(own, before)).cast(a.kind).alias(a.name))
        return rows.select(F.col("e").alias(entity), *(names if n else []))

    united = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [layout(n) for n in range(len(spec) + 1)])
    return united.select(entity, *(a.name for _, _, a in spec))


def cells_of(wide: DataFrame, entity: str, attributes: Mapping[int, Attribute], attribute: str) -> DataFrame:
    """The non-null cells of the wide table as text: ``entity, attribute, cell``."""
    each = F.array(*(F.struct(F.lit(k).cast("int").alias("k"), F.col(a.name).cast("string").alias("x")) for k, a in attributes.items()))
    return wide.select(entity, F.explode(each).alias("z")).where("z.x is not null").select(entity, F.col("z.k").alias(attribute), F.col("z.x").alias("cell"))

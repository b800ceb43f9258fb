"""Sinks: texts, region side-cars, result tables, JSON in one object."""

from __future__ import annotations

import json
import traceback
from collections.abc import Iterable, Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from quireframe.errors import as_header


def preview(text: Column) -> Column:
    """A text on one line; from 40 characters on its first and last 20 with dots between."""
    short = F.when(F.length(text) >= 40, F.concat(F.left(text, F.lit(20)), F.lit("..."), F.right(text, F.lit(20)))).otherwise(text)
    return F.replace(short, F.lit("\n"), F.lit(" "))


def region_rows(reg: DataFrame, book: DataFrame, names: dict[int, str]) -> DataFrame:
    """``name, rclass, start, end, rvalue, preview`` as a side-car has them, by start, wider first, then class."""
    rclass = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    ranges = reg.withColumn("rclass", F.try_element_at(rclass, F.col("rclass_id"))).groupBy("book_id").agg(F.collect_list(F.struct("rclass", "r_start", "r_end", "rvalue")).alias("x"))
    rows = ranges.join(book.select("book_id", "name", "content"), "book_id")
    each = rows.select("name", F.explode(F.arrays_zip("x", _previews("content", "x.r_start", "x.r_end").alias("preview"))).alias("e"))
    return each.select("name", "e.x.rclass", F.col("e.x.r_start").alias("start"), F.col("e.x.r_end").alias("end"), "e.x.rvalue", "e.preview")


@F.pandas_udf(ArrayType(StringType()))
def _previews(contents: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
    """The previews of all ranges of a book: places in a text are found at once here, the JVM counts from the beginning."""

    def one(text: str | None, a: int, z: int) -> str | None:
        if text is None:
            return None
        z = min(z, len(text))
        return (text[a : a + 20] + "..." + text[z - 20 : z] if z - a >= 40 else text[a:z]).replace("\n", " ")

    return pd.Series([[one(t, a, z) for a, z in zip(x, y, strict=True)] for t, x, y in zip(contents, starts, ends, strict=True)], dtype="object")


def write_regions(rows: DataFrame, path: str) -> None:
    """Side-cars as CSV without header, a directory for each book."""
    rows.repartition("name").sortWithinPartitions("name", "start", F.desc("end"), "rclass").write.mode("overwrite").partitionBy("name").csv(path)


def write_texts(book: DataFrame, path: str) -> None:
    """Contents as text that ends with a line end, a directory for each book."""
    book.where("content is not null").select("name", F.regexp_replace("content", "\n\\z", "").alias("value")).repartition("name").write.mode("overwrite").partitionBy("name").text(path)


def result_csv(df: DataFrame, path: str, version: str, url: str) -> None:
    """A result table as CSV, everything quoted, with the corpora's version and the query's address in the header."""
    out = df.select(*(F.regexp_replace(F.regexp_replace(F.col(f"`{c}`").cast("string"), "\n{2,}", "¶ "), "\n+", " ").alias(c) for c in df.columns), F.lit("").alias(version), F.lit("").alias(url))
    out.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').option("lineSep", "\r\n").csv(path)


def saved_table(spark, path: str) -> tuple[DataFrame, str]:
    """A saved result table without its two header fields, and the address of its query."""
    df = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    url = df.columns[-1]
    return df.drop(*df.columns[-2:]), url


class Encoder(json.JSONEncoder):
    """Decimals as text, arrays and rows as lists."""

    def default(self, o):
        if isinstance(o, Decimal):
            return str(o)
        if hasattr(o, "asDict"):
            return list(o)
        return super().default(o)


def json_chunks(rows: Iterable, header: dict | None = None, footer: dict | None = None, long_fields: frozenset[int] = frozenset()) -> Iterator[str]:
    """One JSON object in chunks: the header's entries, ``data`` with a row after the other, the footer's entries.

    An error before the first row is raised; later ones become an entry. ``long_fields`` are given as text.
    """
    if header is not None and not isinstance(header, dict):
        raise ValueError("The header must be an object")
    it = iter(rows)
    done = object()
    first = next(it, done)
    yield "{" + "".join(f"{json.dumps(k)}:{json.dumps(v, cls=Encoder)},\n" for k, v in (header or {}).items()) + '"data":['
    last: dict = dict(footer or {})
    try:
        row, sep = first, "\n"
        while row is not done:
            yield sep + json.dumps([str(x) if i in long_fields else x for i, x in enumerate(row)], cls=Encoder)
            row, sep = next(it, done), ",\n"
    except Exception as e:
        last |= as_header(e, traceback.format_exc())
    yield "\n]" + "".join(f",\n{json.dumps(k)}:{json.dumps(v, cls=Encoder)}" for k, v in last.items()) + "}"


def stream_json(df: DataFrame, header: dict | None = None, footer: dict | None = None) -> Iterator[str]:
    """``df`` as JSON while it comes in, one partition at a time; longs as text."""
    longs = frozenset(i for i, (_, t) in enumerate(df.dtypes) if t == "bigint")
    return json_chunks(df.toLocalIterator(prefetchPartitions=True), header, footer, longs)

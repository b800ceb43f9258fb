"""From texts to the annotated store, and the store's tables on disk."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quireframe.errors import UserError
from quireframe.functions.breaks import ENGLISH
from quireframe.functions.tokenise import token_table
from quireframe.operators import store
from quireframe.operators.tagging import tag_books
from quireframe.session import cut

TABLES = ("book", "text_region", "token", "book_metadata", "book_word_count")
#: Buckets of a new store unless it is told otherwise, and books a bucket should have when a store is begun.
BUCKETS, PER_BUCKET = 64, 2000


def annotate(books: DataFrame, suppress: frozenset[str] = ENGLISH) -> dict[str, DataFrame]:
    """The five tables of ``books`` (book_id, name, content and perhaps given)."""
    reg = cut(tag_books(books, suppress))  # Python per book runs once, not for each table
    tok = cut(store.numbered(token_table(books)))
    full = store.with_part_of(tok, reg)
    meta = store.region_text(books, reg, [101, 102, 302, 303]).drop("r_start")
    counts = store.word_counts(full, reg, [301, 501, 502, 503, 504]).groupBy("book_id", "rclass_id", "rvalue").agg(F.sum("word_count").alias("word_count"))
    return {"book": books.select("book_id", "name", "content"), "text_region": reg, "token": full, "book_metadata": meta, "book_word_count": counts}


def save(tables: dict[str, DataFrame], path: str, buckets: int | None = None) -> None:
    """Puts the books of ``tables`` in place of those with their ids; others stay.

    Tables are divided into buckets of books; a new store gets as many as its first books ask for (or ``buckets``) and
    keeps their number. Only the buckets that the books fall into are written again: first all of them aside, then they
    take the old ones' places, so that what fails while tables are made leaves the store as it was. A bucket that is
    large is written by several tasks, small ones share one.
    """
    books = tables["book"].select("book_id").distinct()
    spark = books.sparkSession
    n = _buckets(spark, path) or buckets or max(BUCKETS, -(-books.count() // PER_BUCKET))
    bucket = bucket_of(F.col("book_id"), n)
    touched = books.select(bucket.alias("bucket")).distinct()
    aside = f"{path}/.next-{uuid.uuid4().hex}"
    for name, df in tables.items():
        rows, target = df.withColumn("bucket", bucket), f"{path}/{name}"
        if _filled(spark, target):
            old = spark.read.schema(rows.schema).parquet(target).join(touched, "bucket", "left_semi").join(books, "book_id", "left_anti")
            rows = rows.unionByName(old, allowMissingColumns=True)
        rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "book_id").write.partitionBy("bucket").parquet(f"{aside}/{name}")
    if _buckets(spark, path) is None:
        spark.createDataFrame([(n,)], "buckets int").coalesce(1).write.mode("overwrite").parquet(f"{path}/layout")
    here = [r["bucket"] for r in touched.collect()]  # no more than there are buckets
    for name in tables:
        for b in here:
            _remove(spark, f"{path}/{name}/bucket={b}")
            if _exists(spark, f"{aside}/{name}/bucket={b}"):
                _move(spark, f"{aside}/{name}/bucket={b}", f"{path}/{name}/bucket={b}")
    _remove(spark, aside)


def bucket_of(book_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(book_id.cast("long")), F.lit(buckets)).cast("int")


def load(spark: SparkSession, path: str, book_ids: Sequence[int] | None = None) -> dict[str, DataFrame]:
    """The store's tables by name; one without any rows so far is missing.

    With ``book_ids`` those of these books alone, for which only the buckets they are in are read.
    """
    out = {}
    for name in TABLES:
        if _filled(spark, f"{path}/{name}"):
            df = spark.read.parquet(f"{path}/{name}")
            if book_ids is not None:
                n = _buckets(spark, path) or BUCKETS
                df = df.where(F.col("bucket").isin([bucket_of(F.lit(i), n) for i in book_ids]) & F.col("book_id").isin(list(book_ids)))
            out[name] = df.drop("bucket")
    return out


def _buckets(spark: SparkSession, path: str) -> int | None:
    """The number of buckets of a store; None if there is no store yet."""
    if _exists(spark, f"{path}/layout"):
        return spark.read.parquet(f"{path}/layout").first()["buckets"]
    return BUCKETS if _filled(spark, f"{path}/book") else None


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _filled(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/bucket=*")
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def _remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _move(spark: SparkSession, path: str, to: str) -> None:
    p, q = (spark._jvm.org.apache.hadoop.fs.Path(x) for x in (path, to))
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(q.getParent())
    if not fs.rename(p, q):
        raise OSError(f"{path} can't be moved to {to}")


def put_corpora(corpora: DataFrame, links: DataFrame, book: DataFrame, path: str) -> None:
    """Replaces the corpora and their links to books by name; every book must be there."""
    known = links.join(book.select(F.col("name").alias("book"), "book_id"), "book", "left")
    missing = [r["book"] for r in known.where("book_id is null").select("book").distinct().limit(5).collect()]
    if missing:
        raise UserError(f"Unknown books: {', '.join(sorted(missing))}")
    numbered = cut(corpora.withColumn("corpus_id", F.row_number().over(Window.orderBy("name"))))  # a table of a few rows
    numbered.write.mode("overwrite").parquet(f"{path}/corpus")
    known.join(numbered.select(F.col("name").alias("corpus"), "corpus_id"), "corpus").select("corpus_id", "book_id").distinct().write.mode("overwrite").parquet(f"{path}/corpus_book")


def set_version(spark: SparkSession, path: str, name: str, version: str) -> None:
    """Notes the version of one part of the repository; others stay."""
    rows = {r["name"]: r["version"] for r in versions(spark, path).collect()} | {name: version}
    spark.createDataFrame(sorted(rows.items()), "name string, version string").coalesce(1).write.mode("overwrite").parquet(f"{path}/repository")


def versions(spark: SparkSession, path: str) -> DataFrame:
    if not _exists(spark, f"{path}/repository"):
        return spark.createDataFrame([], "name string, version string")
    return spark.read.parquet(f"{path}/repository")


def dump(spark: SparkSession, path: str, to: str) -> None:
    """A copy of all tables of the store."""
    for name in (*TABLES, "layout", "corpus", "corpus_book", "repository"):
        if _exists(spark, f"{path}/{name}"):
            df = spark.read.parquet(f"{path}/{name}")
            writer = df.write.mode("overwrite")
            (writer.partitionBy("bucket") if "bucket" in df.columns else writer).parquet(f"{to}/{name}")

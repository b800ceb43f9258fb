"""New text files are annotated as they come in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quireframe.functions.breaks import ENGLISH
from quireframe.operators.importing import annotate, save
from quireframe.sources.books import id_of, stem


def follow(spark: SparkSession, folder: str, store: str, checkpoint: str, suppress: frozenset[str] = ENGLISH, once: bool = False) -> StreamingQuery:
    """Imports each new file of ``folder`` into ``store``; a batch that runs again replaces its own books."""
    rows = spark.readStream.text(folder, wholetext=True)
    books = rows.select(F.url_decode(stem(F.col("_metadata.file_path"))).alias("name"), F.col("value").alias("content")).select(id_of(F.col("name")).alias("book_id"), "name", "content")

    def take(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            save(annotate(batch.dropDuplicates(["book_id"]), suppress), store)

    writer = books.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")).start()

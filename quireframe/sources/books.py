"""Sources: plain-text books, region side-cars, the catalogue of corpora, images, uploaded texts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quireframe.schema import RCLASS_IDS

SIDECAR = "rclass string, start int, end int, rvalue int, preview string"


def stem(path: Column) -> Column:
    """A file's name without folders and extensions."""
    return F.regexp_extract(path, r"([^/]+?)(?:\.regions\.csv|\.[A-Za-z0-9]+)?$", 1)


def id_of(name: Column) -> Column:
    """An id that a book keeps whenever it is imported."""
    return F.xxhash64(name)


def read_books(spark: SparkSession, *paths: str) -> DataFrame:
    """``book_id, name, content`` of text files."""
    rows = spark.read.text(list(paths), wholetext=True)
    return rows.select(F.url_decode(stem(F.col("_metadata.file_path"))).alias("name"), F.col("value").alias("content")).select(id_of(F.col("name")).alias("book_id"), "name", "content")


def read_regions(spark: SparkSession, *paths: str) -> DataFrame:
    """``name, rclass, start, end, rvalue`` of side-cars; an unknown class is an error unless it is to be ignored."""
    rows = spark.read.schema(SIDECAR).option("multiLine", True).option("escape", '"').csv(list(paths))
    rows = rows.select(F.url_decode(stem(F.col("_metadata.file_path"))).alias("name"), "rclass", "start", "end", "rvalue").where(~F.col("rclass").startswith("ignore."))
    known = F.col("rclass").isin(*RCLASS_IDS)
    return rows.withColumn("rclass", F.when(known, F.col("rclass")).otherwise(F.raise_error(F.concat(F.lit("Unknown region class: "), "rclass")).cast("string")))


def with_given(books: DataFrame, side: DataFrame) -> DataFrame:
    """Books with the regions of their side-cars as ``given``."""
    given = side.groupBy("name").agg(F.collect_list(F.struct("rclass", "start", "end", "rvalue")).alias("given"))
    return books.join(given, "name", "left").select("book_id", "name", "content", "given")


def uploaded(spark: SparkSession, name: str, content: str) -> DataFrame:
    """A text as a book of its own."""
    return spark.createDataFrame([(name, content)], "name string, content string").select(id_of(F.col("name")).alias("book_id"), "name", "content")


def _fields(body: str) -> dict[str, str]:
    """The fields of a catalogue entry; braces nest."""
    out, i = {}, 0
    for m in iter(lambda: re.compile(r"\s*,?\s*([A-Za-z_-]+)\s*=\s*").match(body, i), None):
        i = m.end()
        if i < len(body) and body[i] in '{"':
            quote, depth, j = body[i] == '"', 0, i
            while j < len(body):
                depth += (body[j] == "{") - (body[j] == "}")
                j += 1
                if (quote and j - 1 > i and body[j - 1] == '"' and depth == 0) or (not quote and depth == 0):
                    break
            out[m[1].lower()], i = body[i + 1 : j - 1], j
        else:
            n = re.compile(r"[^,}\s]*").match(body, i)
            out[m[1].lower()], i = n[0], n.end()
    return out


def bib_entries(text: str) -> Iterator[dict[str, str]]:
    """The entries of a BibTeX file, each with its fields."""
    for m in re.finditer(r"@\w+\s*\{\s*[^,\s]*\s*,", text):
        depth, j = 1, m.end()
        while j < len(text) and depth:
            depth += (text[j] == "{") - (text[j] == "}")
            j += 1
        yield _fields(text[m.end() : j - 1])


def _bare(x: str) -> str:
    return re.sub(r"[{}]", "", x).strip()


def read_catalogue(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Corpora ``name, title, description, ordering`` and links ``corpus, book`` of a BibTeX catalogue.

    An entry with the keyword ``corpus`` is a corpus; others are books, with the corpora they are in as keywords.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text in pdf["value"]:
                for e in bib_entries(text):
                    words = [_bare(k) for k in e.get("keywords", "").split(",") if _bare(k)]
                    name = _bare(e.get("shorttitle", ""))
                    if "corpus" in words:
                        rows.append((name, f"{name} - {_bare(e.get('title', ''))}", _bare(e.get("abstract", "")), int(_bare(e["number"])), None))
                    else:
                        rows += [(k, None, None, None, name) for k in words]
            yield pd.DataFrame(rows, columns=["name", "title", "description", "ordering", "book"]).astype({"ordering": "Int32"})

    rows = spark.read.text(path, wholetext=True).mapInPandas(scan, "name string, title string, description string, ordering int, book string")
    return rows.where("book is null").select("name", "title", "description", "ordering"), rows.where("book is not null").select(F.col("name").alias("corpus"), "book")


def with_images(corpora: DataFrame, folder: str) -> DataFrame:
    """Corpora with ``carousel_image``, null where ``<name>_0.4.jpg`` is not in the folder."""
    files = corpora.sparkSession.read.format("binaryFile").option("pathGlobFilter", "*_0.4.jpg").load(folder)
    images = files.select(F.regexp_extract("path", r"([^/]+)_0\.4\.jpg$", 1).alias("name"), F.col("content").alias("carousel_image"))
    return corpora.join(images, "name", "left")


def corpora_for(links: DataFrame, books: DataFrame) -> DataFrame:
    """Names of the corpora that hold one of the books."""
    return links.join(books.select(F.col("name").alias("book")), "book", "left_semi").select("corpus").distinct()

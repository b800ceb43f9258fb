"""Tables, region classes and names of subsets."""

from __future__ import annotations

from pyspark.sql import types as T

#: Region classes.
RCLASSES = {
    101: "metadata.title", 102: "metadata.author", 301: "chapter.text", 302: "chapter.title", 303: "chapter.part", 401: "chapter.paragraph", 402: "chapter.sentence",
    501: "quote.quote", 502: "quote.nonquote", 503: "quote.suspension.short", 504: "quote.suspension.long", 505: "quote.embedded", 506: "quote.embedded.suspension.short", 507: "quote.embedded.suspension.long",
}
RCLASS_IDS = {name: i for i, name in RCLASSES.items()}
#: Public names of subsets.
SUBSETS = {"all": 301, "quote": 501, "nonquote": 502, "shortsus": 503, "longsus": 504}

_i, _l, _s = T.IntegerType(), T.LongType(), T.StringType()
BOOK = T.StructType([T.StructField("book_id", _l), T.StructField("name", _s), T.StructField("content", _s)])
REGION = T.StructType([T.StructField("book_id", _l), T.StructField("rclass_id", _i), T.StructField("r_start", _i), T.StructField("r_end", _i), T.StructField("rvalue", _i)])
TOKEN = T.StructType([T.StructField("book_id", _l), T.StructField("tok_start", _i), T.StructField("tok_end", _i), T.StructField("ttype", _s), T.StructField("ordering", _i), T.StructField("part_of", T.MapType(_i, _i))])
CORPUS = T.StructType([T.StructField("corpus_id", _i), T.StructField("name", _s), T.StructField("title", _s), T.StructField("carousel_image", T.BinaryType()), T.StructField("ordering", _i)])
CORPUS_BOOK = T.StructType([T.StructField("corpus_id", _i), T.StructField("book_id", _l)])


def rclass_id(name: str) -> int:
    """The id of a region class by its name; KeyError if there is none."""
    return RCLASS_IDS[name]


def subset_id(name: str) -> int:
    """The id of the region class behind a subset's public name; KeyError if there is none."""
    return SUBSETS[name]

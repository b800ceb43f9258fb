"""Phrases in context: matches of wildcard phrases within a subset, with the tokens and the text around them."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from quireframe.errors import UserError
from quireframe.functions.tokenise import anchor, parse_query
from quireframe.operators.store import in_class, value_of, with_substring
from quireframe.session import cut

#: Rows of hits with their places up to which they are sent to all tasks instead of shuffling the tokens.
SENT = 500_000

WINDOW = StructType([StructField("parts", ArrayType(StringType())), StructField("words", ArrayType(IntegerType()))])
WINDOWS = StructType([StructField(n, WINDOW) for n in ("left", "node", "right")])


def matches(tok: DataFrame, patterns: Sequence[str], rclass: int, context: int = 0) -> DataFrame:
    """Every place where the patterns follow each other in tokens of the class, with up to ``context`` tokens around.

    ``book_id, position`` (of the first node token), ``start, end, left, node, right`` (arrays of tokens as structs of
    ttype, tok_start, tok_end), ``chapter, paragraph, sentence`` (-1 where there is none, from the anchor token).
    Boundaries of regions between node tokens don't matter; context is of any class and ends with the book.

    Repeated rows count once. The anchor, the pattern with the fewest hits to expect, is looked up first and its hits
    are kept. Only they ask for their neighbours, by (book_id, ordering): up to ``SENT`` places asked for are sent to
    all tasks, so that the token table is only scanned; more are joined by shuffling both sides.
    """
    if not patterns:
        raise UserError("The query has no words")
    k, i = len(patterns), anchor(list(patterns))
    own = in_class(rclass)
    hits = tok.where(F.col("ttype").like(patterns[i]) & own).select("book_id", F.col("ordering").alias("at"), value_of(301).alias("chapter"), value_of(401).alias("paragraph"), value_of(402).alias("sentence")).distinct()
    hits = cut(hits)
    few = hits.count() * (k + 2 * context) <= SENT
    asked = hits.withColumn("off", F.explode(F.sequence(F.lit(-i - context), F.lit(k - 1 - i + context)))).withColumn("need", F.col("at") + F.col("off")).withColumnRenamed("book_id", "b")
    rows = tok.select("book_id", "ordering", "ttype", "tok_start", "tok_end", own.alias("inside"))
    found = (F.broadcast(asked) if few else asked).join(rows, (F.col("b") == F.col("book_id")) & (F.col("need") == F.col("ordering")))
    token = F.struct("ttype", "tok_start", "tok_end")
    each = F.array_sort(F.collect_set(F.struct((F.col("off") + i).alias("o"), token.alias("t"), "inside")))
    lines = found.groupBy("book_id", "at", "chapter", "paragraph", "sentence").agg(each.alias("all"))
    lines = lines.withColumn("mid", F.filter("all", lambda x: (x["o"] >= 0) & (x["o"] < k)))
    fits = F.size("mid") == k
    for j, p in enumerate(patterns):
        fits = fits & F.coalesce(F.get("mid", F.lit(j))["inside"] & F.get("mid", F.lit(j))["t"]["ttype"].like(p), F.lit(False))

    def side(test) -> Column:
        return F.transform(F.filter("all", test), lambda x: x["t"])

    lines = lines.where(fits)
    return lines.select(
        "book_id", (F.col("at") - i).alias("position"), F.get("mid", F.lit(0))["t"]["tok_start"].alias("start"), F.get("mid", F.lit(k - 1))["t"]["tok_end"].alias("end"),
        side(lambda x: x["o"] < 0).alias("left"), side(lambda x: (x["o"] >= 0) & (x["o"] < k)).alias("node"), side(lambda x: x["o"] >= k).alias("right"), "chapter", "paragraph", "sentence",
    )


def concordance(tok: DataFrame, queries: Sequence[str], rclasses: Sequence[int], context: int = 0) -> DataFrame:
    """The lines of all queries one after another: a line that two queries match comes twice. Exactly one class."""
    if len(rclasses) != 1:
        raise UserError("You must supply exactly one subset")
    if not queries:
        raise UserError("Nothing to search for")
    out: DataFrame | None = None
    for n, q in enumerate(queries):
        lines = matches(tok, parse_query(q), rclasses[0], context).withColumn("query", F.lit(n))
        out = lines if out is None else out.unionAll(lines)
    return out


def _append(parts: list[str], text: str) -> None:
    if text:
        parts.append(text)


def windows(text: str, offset: int, tokens: list[tuple[int, int]], n_left: int, n_node: int) -> dict[str, dict[str, list]]:
    """The text of a line in three windows; ``text`` begins at ``offset``. Text between tokens is kept as it is.

    Text between the node and a neighbour is divided at its first white space, which goes to the neighbour's window; text
    before the first token and after the last is not given.
    """
    out = {k: {"parts": [], "words": []} for k in ("left", "node", "right")}
    side = lambda i: "left" if i < n_left else "node" if i < n_left + n_node else "right"
    for i, (a, z) in enumerate(tokens):
        here = out[side(i)]
        if i:
            gap, old = text[tokens[i - 1][1] - offset : a - offset], out[side(i - 1)]
            if old is here:
                _append(here["parts"], gap)
            else:
                space = re.search(r"\s+", gap)
                head, blank, tail = (gap[: space.start()], space[0], gap[space.end() :]) if space else (gap, "", "")
                _append(old["parts"], head)
                _append((old if side(i) == "node" else here)["parts"], blank)
                _append(here["parts"], tail)
        here["words"].append(len(here["parts"]))
        here["parts"].append(text[a - offset : z - offset])
    return out


def with_text(lines: DataFrame, book: DataFrame) -> DataFrame:
    """``lines`` with the text of their windows as ``left, node, right``: parts, and which of them are words."""
    every = F.concat("left", "node", "right")
    rows = lines.withColumns({"first_": F.get(every, F.lit(0))["tok_start"], "last_": F.get(every, F.size(every) - 1)["tok_end"]})
    cut = with_substring(rows, book, "first_", "last_", "seen").drop("first_", "last_")
    cut = cut.withColumns({"a": F.transform(every, lambda t: t["tok_start"]), "z": F.transform(every, lambda t: t["tok_end"]), "nl": F.size("left"), "nn": F.size("node")})

    @F.pandas_udf(WINDOWS)
    def divide(seen: pd.Series, a: pd.Series, z: pd.Series, nl: pd.Series, nn: pd.Series) -> pd.DataFrame:
        rows = [windows(s, int(x[0]) if len(x) else 0, list(zip(map(int, x), map(int, y), strict=True)), l, n) for s, x, y, l, n in zip(seen, a, z, nl, nn, strict=True)]  # noqa: E741
        return pd.DataFrame(rows, columns=["left", "node", "right"])

    done = cut.withColumn("w", divide("seen", "a", "z", "nl", "nn")).drop("left", "node", "right", "seen", "a", "z", "nl", "nn")
    return done.select("*", "w.left", "w.node", "w.right").drop("w")

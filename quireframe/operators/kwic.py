"""Work on result lines: context words, grouping by book, frequencies, sorting, filtering, pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def span(text: str) -> tuple[tuple[int, int] | None, tuple[int, int] | None]:
    """'min:max' as distances (from, to) to look at on the left and on the right, None for a side not looked at."""
    low, high = (int(x) for x in text.split(":"))
    left = (-min(high, -1), -low) if low < 0 else None
    right = (max(low, 1), high) if high >= 0 else None
    return left, right


def _within(words: Column, side: tuple[int, int] | None) -> Column:
    return F.array().cast("array<string>") if side is None else F.slice(words, side[0], max(0, side[1] - side[0] + 1))


def near(left: Column, right: Column, spans: str) -> Column:
    """The context words within a span, nearest first on either side; ``left`` is in reading order."""
    a, b = span(spans)
    return F.concat(_within(F.reverse(left), a), _within(right, b))


def score(left: Column, right: Column, terms: Sequence[str], spans: str) -> Column:
    """How many distinct ``terms`` (in lower case) occur within the span."""
    return F.size(F.array_intersect(F.array_distinct(near(left, right, spans)), F.array(*(F.lit(t.lower()) for t in terms))))


def node_score(node: Column, terms: Sequence[str], stop: int, from_end: bool = False) -> Column:
    """As ``score`` over the first (or last) ``stop`` words of the node itself."""
    words = F.slice(F.reverse(node) if from_end else node, 1, stop)
    return F.size(F.array_intersect(F.array_distinct(words), F.array(*(F.lit(t.lower()) for t in terms))))


def positions(words: Column, terms: Sequence[str], start: int, stop: int) -> Column:
    """Distances (from 1) between start and stop at which one of the terms stands; ``words`` nearest first."""
    hit = F.transform(F.slice(words, 1, stop), lambda w, i: F.when(w.isin([t.lower() for t in terms]) & (i + 1 >= start), i + 1))
    return F.array_compact(hit)


def highlight(kwic: Column) -> Column:
    """The class of a line's highlight: 1 to 4 in turn."""
    return kwic % 4 + 1


def summary(lines: DataFrame, kwic: str = "kwic", book: str = "book_id") -> DataFrame:
    """``kwic, lines, books``: lines and distinct books for each number of matches."""
    return lines.groupBy(kwic).agg(F.count(F.lit(1)).alias("lines"), F.count_distinct(book).alias("books"))


def by_book(lines: DataFrame, book: str = "book_id", kwic: str = "kwic") -> DataFrame:
    """``book, lines, max_kwic, kwic_count``: lines per book, the most matches of one, and how many lines match."""
    return lines.groupBy(book).agg(F.count(F.lit(1)).alias("lines"), F.max(kwic).alias("max_kwic"), F.count_if(F.col(kwic) > 0).alias("kwic_count"))


def per_million(part: Column, whole: Column) -> Column:
    """Relative frequency per million, two digits."""
    return F.round(part / whole * 1_000_000, 2)


def share(part: Column, whole: Column) -> Column:
    """Share in per cent, two digits."""
    return F.round(part / whole * 100, 2)


def sort_key(words: Column, left: bool = False) -> Column:
    """The first three words, each with a colon after it; for the left context the last three, nearest first."""
    w = F.slice(F.reverse(words) if left else words, 1, 3)
    return F.array_join(F.transform(w, lambda x: F.concat(x, F.lit(":"))), "")


def row_filter(df: DataFrame, columns: Sequence[str], text: str) -> DataFrame:
    """Rows in one of whose cells, put together, ``text`` occurs, whatever the case."""
    return df.where(F.lower(F.concat_ws(" ", *(F.col(c).cast("string") for c in columns))).contains(text.lower()))


def row_id(book: str = "book", start: str = "start", end: str = "end") -> Column:
    return F.concat_ws(":", F.col(book).cast("string"), F.col(start).cast("string"), F.col(end).cast("string"))


def all_words(lines: DataFrame, left: str, right: str, spans: str) -> DataFrame:
    """``ttype``: distinct words met while looking for context words, from distance 1 on."""
    a, b = span(spans)
    words = F.concat(_within(F.reverse(left), (1, a[1]) if a else None), _within(F.col(right), (1, b[1]) if b else None))
    return lines.select(F.explode(words).alias("ttype")).distinct()


def page(df: DataFrame, order: Sequence[Column], number: int, size: int = 50) -> DataFrame:
    """One page of the ordered result, with the position ``row`` on it."""
    rows = df.orderBy(*order).offset(number * size).limit(size)
    return rows.withColumn("row", F.row_number().over(Window.orderBy(*order)))


def paragraph_marks(text: Column) -> Column:
    """Blank lines as pilcrows, other line ends as spaces."""
    return F.regexp_replace(F.regexp_replace(text, "\n{2,}", "¶ "), "\n+", " ")


def relative_position(start: Column, end_of_book: Column) -> Column:
    return start / end_of_book


def headings_with_part(reg_text: DataFrame) -> DataFrame:
    """Chapter headings (302) with the text of the last part heading (303) before them; needs ``content``."""
    w = Window.partitionBy("book_id").orderBy("r_start").rowsBetween(Window.unboundedPreceding, -1)
    rows = reg_text.withColumn("part", F.last(F.when(F.col("rclass_id") == 303, F.col("content")), ignorenulls=True).over(w))
    return rows.where("rclass_id = 302").select("book_id", "r_start", F.concat_ws(" ", "part", "content").alias("heading"))

"""Array helpers that stay inside Spark expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` (also in its lambdas) refers to it."""
    return F.transform(F.array(value), body)[0]


def prefix_sums(lengths: Column, block: int = 64) -> Column:
    """For an array of integers, the sum of all elements before each one; blocks keep the work far below quadratic."""
    add = lambda a, x: a + x
    zero = F.lit(0)

    def starts(n: Column) -> Column:
        blocks = F.sequence(zero, F.expr("0") + F.floor((F.size(n) - 1) / block).cast("int"))
        sums = F.transform(blocks, lambda b: F.aggregate(F.slice(n, b * block + 1, block), zero, add))

        def within(s: Column) -> Column:
            before = F.transform(blocks, lambda b: F.aggregate(F.slice(s, 1, b), zero, add))
            return let(before, lambda f: F.transform(n, lambda x, i: F.get(f, F.floor(i / block).cast("int")) + F.aggregate(F.slice(n, F.floor(i / block).cast("int") * block + 1, i % block), zero, add)))

        return let(sums, within)

    return let(lengths, lambda n: F.when(F.size(n) > 0, starts(n)).otherwise(n))


def cut_at(text: Column, mark: str) -> Column:
    """The pieces of ``text`` between occurrences of ``mark`` (one character, taken out) as structs ``text, start``."""
    return let(
        F.split(text, mark, -1),
        lambda p: let(prefix_sums(F.transform(p, F.length)), lambda s: F.transform(p, lambda x, i: F.struct(x.alias("text"), F.get(s, i).alias("start")))),
    )

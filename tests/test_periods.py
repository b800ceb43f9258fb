from __future__ import annotations

import random

import pytest

from quireframe.operators.periods import periods_and_gaps

SCHEMA = "book_id long, rclass_id int, r_start int, r_end int"


def brute(data):
    out, by = [], {}
    for b, c, a, z in data:
        if a is not None and z is not None and z > a:
            by.setdefault((b, c), []).append((a, z))
    for (b, c), ranges in by.items():
        merged = []
        for a, z in sorted(ranges):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], z)
            else:
                merged.append([a, z])
        out += [(b, c, "period", a, z) for a, z in merged]
        out += [(b, c, "gap", p[1], q[0]) for p, q in zip(merged, merged[1:])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed, span, n, partitions", [(1, 60, 400, 1), (2, 60, 400, 7), (3, 5000, 600, 16), (4, 400, 2000, 23)])
def test_random(spark, rows, seed, span, n, partitions):
    r = random.Random(seed)
    # one entity holds a third of all rows, and one range spans many partitions
    data = [(None if r.random() < 0.02 else 1 if r.random() < 0.33 else r.randrange(8), r.choice([301, 401, None]), a, a + r.randrange(-2, 40)) for a in (r.randrange(span) for _ in range(n))]
    data += [(1, 301, 5, span - 3)] + data[:20] + [(2, 301, None, 4), (2, 301, 4, None)]
    got = rows(periods_and_gaps(spark.createDataFrame(data, SCHEMA).repartition(5), ["book_id", "rclass_id"], "r_start", "r_end", partitions))
    assert got == brute(data)


def test_touching_nested_and_blank(spark, rows):
    df = spark.createDataFrame([(1, 1, 0, 5), (1, 1, 5, 9), (1, 1, 2, 3), (1, 1, 12, 12), (1, 1, 20, 22)], SCHEMA)
    assert rows(periods_and_gaps(df, ["book_id", "rclass_id"], "r_start", "r_end")) == [(1, 1, "gap", 9, 20), (1, 1, "period", 0, 9), (1, 1, "period", 20, 22)]


def test_empty_and_clashing_columns(spark, rows):
    empty = spark.createDataFrame([], SCHEMA)
    assert rows(periods_and_gaps(empty, ["book_id", "rclass_id"], "r_start", "r_end")) == []
    odd = spark.createDataFrame([(1, 1, 0, 5, "x", 3, 4)], SCHEMA + ", kind string, s int, p int")
    got = periods_and_gaps(odd, ["book_id", "rclass_id"], "r_start", "r_end")
    assert got.columns == ["book_id", "rclass_id", "kind", "span_start", "span_end"] and rows(got) == [(1, 1, "period", 0, 5)]

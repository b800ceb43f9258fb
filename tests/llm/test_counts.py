from __future__ import annotations

import random
from collections import Counter, defaultdict

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quireframe.llm.frequency import mark_extremes, value_frequencies
from quireframe.llm.heavy import heavy_hitters, merge, summarise


def stream(seed, n):
    r = random.Random(seed)
    return [None if r.random() < 0.05 else "hot" if r.random() < 0.3 else f"w{int(r.paretovariate(0.7))}" for _ in range(n)]


@pytest.mark.parametrize("seed, capacity, fan_in", [(1, 120, 2), (2, 200, 3), (3, 4096, 16)])
def test_heavy_exact_and_bounded(spark, seed, capacity, fan_in):
    values = stream(seed, 20_000)
    df = spark.createDataFrame([(v, "x") for v in values], "ttype string, n string").repartition(9)
    true, total = Counter(v for v in values if v is not None), sum(v is not None for v in values)
    got = {r["ttype"]: r for r in heavy_hitters(df, "ttype", 0.01, capacity, fan_in).collect()}
    assert {k: r["n"] for k, r in got.items()} == {k: c for k, c in true.items() if c >= 0.01 * total}
    for r in got.values():
        assert r["estimate"] - r["error"] <= r["n"] <= r["estimate"]
    s = summarise(df, "ttype", capacity, fan_in).toPandas()
    assert len(s) <= capacity and s["total"].iloc[0] == total
    assert all(row.n - row.err <= true[row.v] <= row.n for row in s.itertuples())
    kept = set(s["v"])
    assert max((c for v, c in true.items() if v not in kept), default=0) <= s["floor"].iloc[0]


def test_heavy_edges(spark, rows):
    empty = spark.createDataFrame([], "ttype string")
    assert rows(heavy_hitters(empty, "ttype", 0.1)) == [] and rows(heavy_hitters(spark.createDataFrame([(None,)], "ttype string"), "ttype", 0.1)) == []
    ties = spark.createDataFrame([(w, 1, "e") for w in "aabbcc"], "ttype string, v int, node string")
    assert [r[:2] for r in rows(heavy_hitters(ties, "ttype", 1 / 3, capacity=10))] == [("a", 2), ("b", 2), ("c", 2)]
    with pytest.raises(ValueError):
        heavy_hitters(ties, "ttype", 0.001, capacity=100)


def test_merge_keeps_bounds():
    part = lambda d: pd.DataFrame({"v": list(d), "n": list(d.values()), "err": 0, "floor": 0, "total": sum(d.values())})
    a = merge([part({"a": 5, "b": 3, "c": 1}), part({"a": 2, "d": 4})], 2)
    assert dict(zip(a["v"], a["n"])) == {"a": 7, "d": 4} and a["floor"].iloc[0] == 3 and a["total"].iloc[0] == 15
    b = merge([a, part({"b": 2})], 5)
    assert dict(zip(b["v"], b["n"]))["b"] == 5 and dict(zip(b["v"], b["err"]))["b"] == 3


def test_frequencies_against_brute(spark):
    r = random.Random(5)
    data = [(1 if r.random() < 0.4 else r.randrange(30), r.randrange(20_000), v) for v in stream(6, 5000)]
    data += data[:300]  # repeated rows
    df = spark.createDataFrame([(*d, "x") for d in data], "book long, pos int, w string, n string").repartition(6)
    occ, recs = Counter(), defaultdict(set)
    for b, p, w in set(data):
        if w is not None:
            occ[w] += 1
            recs[w].add(b)
    got = {r["w"]: (r["occurrences"], r["records"]) for r in value_frequencies(df, "w", "book", "pos").collect()}
    assert got == {w: (n, len(recs[w])) for w, n in occ.items()}
    plain = {r["w"]: r["occurrences"] for r in value_frequencies(df, "w", "book").collect()}
    assert plain == Counter(w for _, _, w in data if w is not None)
    marks = {r["w"]: r["mark"] for r in mark_extremes(value_frequencies(df, "w", "book", "pos"), 30).collect()}
    assert all(m == ("rare" if occ[w] < 3 else "common" if len(recs[w]) > 15 else None) for w, m in marks.items()) and "common" in marks.values()


def test_frequency_edges(spark, rows):
    df = spark.createDataFrame([(None, 1, "a"), (None, 1, "a"), (1, None, "a"), (1, 2, None), (1, 3, "á"), (1, 3, "b")], "book long, pos int, w string")
    assert rows(value_frequencies(df, "w", "book", "pos")) == [("a", 2, 2), ("b", 1, 1), ("á", 1, 1)]
    assert rows(value_frequencies(df.limit(0), "w", "book", "pos")) == []


def test_blocks_and_null_records(spark):
    """Positions in several blocks, before 0 and null; records that are null or no numbers."""
    data = [("a", r, p) for r in (None, "x", "y") for p in (0, 5, 5, 40_000, 40_000, 99_999, -3, None, None)] + [(None, "x", 7)]
    df = spark.createDataFrame(data, "w string, book string, pos int").repartition(7)
    for block in (1 << 15, 1000, 7):
        assert [tuple(r) for r in value_frequencies(df, "w", "book", "pos", block).collect()] == [("a", 18, 3)]
    dated = df.withColumn("book", F.when(F.col("book") == "x", F.current_date()))
    assert [tuple(r) for r in value_frequencies(dated, "w", "book", "pos").collect()] == [("a", 12, 2)]
    with pytest.raises(ValueError):
        value_frequencies(df, "w", "book", "pos", 1 << 16)

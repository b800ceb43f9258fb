from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quireframe.functions import notations as n
from quireframe.operators.wide import Attribute, cells_of, to_wide

ATTRS = {1: Attribute("title", n.text, "string"), 2: Attribute("year", n.year, "int"), 3: Attribute("seen", n.truth, "boolean")}
SCHEMA = "e long, a int, v string, t timestamp"
T = [dt.datetime(2024, 1, d) for d in range(1, 10)]


@pytest.mark.parametrize(
    "read, pairs",
    [
        (n.year, {"1893.": 1893, "[1823]": 1823, "(1861)": 1861, "published 1909": 1909, "A.D. 1793": 1793, "MDCCXCV": 1795, "１８１１": 1811, " 1787 ": 1787, "1884-86": None, "1858 or 1859": None, "190?": None, "18—": None, "undated": None, "": None, None: None, "1799-101": None, "MDCCXCVX": None, "c. 1850": None}),
        (n.count, {"3.0": 3, "012": 12, "in two volumes": 2, "2 vols.": 2, "6 v.": 6, "VIII": 8, "Twelve": 12, "１０": 10, "2 or 3": None, "several": None, "vols.": None, "-": None, "0": None}),
        (n.day, {"1789-05-21": "1789-05-21", "17971021": "1797-10-21", "1868/06/12": "1868-06-12", "1859-05-20T00:00:00": "1859-05-20", "NOVEMBER 23 1818": "1818-11-23", "22 Jan. 1821": "1821-01-22", "December 8, 1907": "1907-12-08", "05/25/1791": "1791-05-25", "21/01/1797": "1797-01-21", "03/04/1850": None, "04/04/1850": "1850-04-04", "24.5.1891": "1891-05-24", "9 May. 1810": "1810-05-09", "31 June 1792": None, "1806-13-05": None, "1889-02-30": None, "May 1817": None, "spring 1848": None}),
        (n.truth, {"t": True, "0": False, " Yes": True, "No ": False, "N": False, "2": None, "maybe": None, "y/n": None}),
        (n.centimetres, {"29.6cm": "29.6", "３０.８": "30.8", "21,7": "21.7", "0.301 m": "30.1", "181 mm": "18.1", "+12.0": "12.0", "33½ cm": "33.5", "28½": "28.5", "17": "17.0", "36.70": "36.7", "18-20 cm": None, "octavo": None, "cm": None}),
        (n.text, {"  a\n b ": "a b", "N/A": None, "?": None, "—": None, "unknown": None, "\t": None, " 丘鍵や ": "丘鍵や"}),
    ],
)
def test_notations(spark, read, pairs):
    df = spark.createDataFrame([(k,) for k in pairs], "v string")
    got = {r["v"]: r["x"] for r in df.select("v", F.transform(F.array("v"), read)[0].cast("string").alias("x")).collect()}
    assert got == {k: None if v is None else str(v).lower() if isinstance(v, bool) else str(v) for k, v in pairs.items()}


def test_last_readable_value_counts(spark, rows):
    data = [(1, 1, "Old", T[0]), (1, 1, "New", T[2]), (1, 1, "?", T[3]), (1, 2, "1850", T[1]), (1, 2, "185?", T[2]), (2, 2, "MDCCC", T[0]), (2, 2, "MDCCC", T[0]), (3, 9, "x", T[0]), (3, None, "y", T[0]), (None, 1, "z", T[0]), (4, 3, "n", None), (4, 1, None, T[0])]
    df = spark.createDataFrame(data, SCHEMA)
    expected = [(1, "New", 1850, None), (2, None, 1800, None), (3, None, None, None), (4, None, None, False)]
    assert rows(to_wide(df, "e", "a", "v", "t", ATTRS)) == expected
    assert rows(cells_of(to_wide(df, "e", "a", "v", "t", ATTRS), "e", ATTRS, "a")) == [(1, 1, "New"), (1, 2, "1850"), (2, 2, "1800"), (4, 3, "false")]


def test_every_set_of_attributes(spark):
    """256 sets of eight attributes, each a table of its own; one set holds a third of all entities."""
    plain = {i: Attribute(f"c{i}x", n.text, "string") for i in range(8)}
    sets = [*range(256), *[37] * 128]
    data = [(e, a, f"v{e}-{a}", T[0]) for e, bits in enumerate(sets) for a in range(8) if bits >> a & 1] + [(0, 99, "only a row", T[0])]
    got = {r["e"]: r for r in to_wide(spark.createDataFrame(data, SCHEMA), "e", "a", "v", "t", plain).collect()}
    assert len(got) == len(sets)
    assert all(got[e][f"c{a}x"] == (f"v{e}-{a}" if bits >> a & 1 else None) for e, bits in enumerate(sets) for a in range(8))


def test_empty_ties_and_clashes(spark, rows):
    assert rows(to_wide(spark.createDataFrame([], SCHEMA), "e", "a", "v", "t", ATTRS)) == []
    df = spark.createDataFrame([(1, 1, "b", T[0], "q", "r"), (1, 1, "a", T[0], "q", "r")], SCHEMA + ", sig string, title string")
    got = to_wide(df, "e", "a", "v", "t", ATTRS)
    assert got.columns == ["e", "title", "year", "seen"] and rows(got) == [(1, "b", None, None)]
    assert dict(got.dtypes) == {"e": "bigint", "title": "string", "year": "int", "seen": "boolean"}


def test_height_type(spark):
    df = spark.createDataFrame([(1, 7, "22½ cm", T[0])], SCHEMA)
    assert to_wide(df, "e", "a", "v", "t", {7: Attribute("h", n.centimetres, "decimal(8,1)")}).first()["h"] == Decimal("22.5")

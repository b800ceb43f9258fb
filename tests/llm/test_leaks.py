from __future__ import annotations

import random

import numpy as np
import pytest

import __spark_entry__ as entry
from quireframe.llm.leaks import Walk, _distance, _distances, edited, for_recall, keys, leaked_items, leaks, passages, reduced

D, I = "doc_id long, text string, item long, at int", "item_id long, text string, id long"


def text_of(codes):
    return codes.astype("<u4").tobytes().decode("utf-32-le")


def words(r, n, letters="abcdefghiklmnoprstuvwy"):
    return " ".join("".join(r.choice(letters) for _ in range(r.randrange(1, 9))) for _ in range(n))


def disguise(r, t):
    out = []
    for c in t:
        k = r.random()
        if k < 0.05 and c in "aceopxy":
            c = dict(zip("aceopxy", "асеорху"))[c]
        elif k < 0.1 and c.isalpha() and c.isascii():
            c = chr(ord(c) + 0xFEE0)
        elif k < 0.2:
            c = c.upper()
        out.append(c + (r.choice(["​", "-", " ,", "\n> ", "\xad"]) if r.random() < 0.1 else ""))
    return "".join(out)


def brute(docs, items, run=60):
    out = set()
    for d, t in docs:
        x = text_of(reduced(t)) if t else ""
        for i, s in items:
            y = text_of(reduced(s)) if s else ""
            if any(y[k : k + run] in x for k in range(len(y) - run + 1)):
                out.add((d, i))
    return sorted(out, key=repr)


def test_found_against_brute(spark, rows):
    r = random.Random(7)
    items = [(i, words(r, 40)) for i in range(12)] + [(20, None), (21, ""), (22, "too short")]
    items.append((30, "An intro. " + items[0][1]))  # shares text
    items.append((31, "доме ёлка " * 12))
    docs = []
    for d in range(80):
        i = r.randrange(12)
        item = items[i][1]
        a = r.randrange(0, 60)
        part = item[a : a + r.choice([70, 74, 78, 82, 120, 400])]
        docs.append((d, words(r, r.randrange(0, 60)) + " " + disguise(r, part) + " " + words(r, r.randrange(0, 60))))
    docs += [(100, None), (101, ""), (102, " ​ "), (103, items[3][1] * 3), (104, items[5][1]), (105, ("ДОМЕ ЁЛКА " * 12).lower()), (106, words(r, 30_000) + items[2][1])]
    docs += [docs[-1]]
    dd = spark.createDataFrame([(*d, 1, 1) for d in docs], D).repartition(5)
    ii = spark.createDataFrame([(*i, 1) for i in items], I)
    expected = brute(docs, items)
    assert rows(leaked_items(dd, ii, "doc_id", "text", "item_id", "text")) == expected and len(expected) > 40
    assert rows(leaked_items(dd.limit(0), ii, "doc_id", "text", "item_id", "text")) == [] and rows(leaked_items(dd, ii.limit(0), "doc_id", "text", "item_id", "text")) == []


def test_recall_of_windows_with_edits(spark):
    r = random.Random(8)
    walk = for_recall(Walk(stride=5, sample=10), edits=2, recall=0.97)
    assert 1 < walk.repeats < 90 and for_recall(Walk(), 0, 0.99).repeats == 1
    items = [(i, words(r, 60)) for i in range(60)]
    docs = []
    for i, t in items:
        x = text_of(reduced(t))[50:95]
        docs.append((i, words(r, 20) + "".join("z" if k in (9, 31) else c for k, c in enumerate(x)) + words(r, 20)))  # two letters of a window changed
    got = leaks(spark.createDataFrame(docs, "d long, t string"), spark.createDataFrame(items, "i long, t string"), "d", "t", "i", "t", walk, most_edits=3).collect()
    assert len({g["doc"] for g in got if g["doc"] == g["item"]}) >= 0.9 * len(items)
    assert all(g["edits"] <= 3 and g["run"] < 60 for g in got)


def test_embedding():
    r = random.Random(9)
    w = Walk(window=40, repeats=3)
    a = reduced(words(r, 60))
    k = keys(a, np.arange(len(a) - 40), w)
    assert (keys(a[7:], np.array([0, 5]), w) == k[:, [7, 12]]).all()  # a window's key depends on its text alone
    assert len(np.unique(k[0])) > 0.9 * k.shape[1]


def test_reduced_and_distance():
    assert text_of(reduced("Ｃаfé’s e​́, 12!")) == text_of(reduced("CAFÉ s é12")) and len(reduced("é́é")) == 2
    assert _distance("kitten", "sitting", 4) == 3 and _distance("kitten", "sitting", 2) == 3 and _distance("", "abc", 5) == 3 and _distance("abc", "abc", 0) == 0


@pytest.mark.parametrize("edits", [1, 2, 3, 4])
def test_default_recall_of_windows_with_edits(spark, edits):
    """At the defaults nine in ten windows with up to four changed letters are found."""
    r = random.Random(11 + edits)
    items = [(i, text_of(reduced(words(r, 60)))[:40]) for i in range(300)]  # one window each, at the start of its text
    docs = []
    for i, t in items:
        changed = r.sample(range(40), edits)
        docs.append((i, "".join("9" if k in changed else c for k, c in enumerate(t))))
    got = leaks(spark.createDataFrame(docs, "d long, t string"), spark.createDataFrame(items, "i long, t string"), "d", "t", "i", "t").collect()
    assert len({g["doc"] for g in got if g["doc"] == g["item"]}) >= 0.9 * len(items)


def test_recall_that_cannot_be_had():
    with pytest.raises(ValueError):
        for_recall(Walk(sample=60), 12, 0.99, most=50)


def test_the_same_passage_everywhere(spark):
    """One letter again and again, and boilerplate in every text and item: each place is found, none is paired with each."""
    boiler = "theusualnoticeattheendofeverytextthatnobodyreads" * 2
    items = [(i, boiler) for i in range(40)] + [(99, "x" * 4000)]
    docs = [(d, "abc" + boiler + "xyz") for d in range(200)] + [(500, "x" * 20_000)]
    got = leaked_items(spark.createDataFrame(docs, "d long, t string"), spark.createDataFrame(items, "i long, t string"), "d", "t", "i", "t").collect()
    assert sorted(map(tuple, got)) == sorted([*((d, i) for d in range(200) for i in range(40)), (500, 99)])


@pytest.mark.parametrize("run", [1, 12, 20, 39, 40, 41, 100])
def test_runs_of_any_length(spark, rows, run):
    """A run shorter than a window of 40 is found as well as a longer one."""
    r = random.Random(run)
    letters = "abcd" if run < 40 else "abcdefghiklmnoprstuvwy"
    items = [(i, words(r, 40 if run > 1 else 1, letters if run > 1 else "abcdefghijklmnopqrstuvwxyz"[i])) for i in range(12)]
    docs = []
    for d in range(60):
        t = text_of(reduced(items[d % 12][1]))
        a = r.randrange(0, max(1, len(t) - run))
        docs.append((d, words(r, r.randrange(0, 30), "efgh") + t[a : a + run + r.choice([-1, 0, 1])] + words(r, r.randrange(0, 30), "efgh")))
    got = rows(leaked_items(spark.createDataFrame(docs, "d long, t string"), spark.createDataFrame(items, "i long, t string"), "d", "t", "i", "t", run))
    assert got == brute(docs, items, run) and len(got) >= 30


def test_runs_have_letters(spark):
    none = spark.createDataFrame([], "d long, t string")
    with pytest.raises(ValueError):
        leaked_items(none, none, "d", "t", "d", "t", 0)


def test_edited_passages_of_documents(spark, tmp_path):
    """The query's own parameters: passages with a letter changed in ten come out beside unbroken ones, each with its item."""
    r = random.Random(21)
    items = [(i, text_of(reduced(words(r, 60)))[:220]) for i in range(200)]
    docs = [(i, words(r, 20) + "".join("9" if k % 10 == i % 10 else c for k, c in enumerate(t[50:150])) + words(r, 20)) for i, t in items]
    docs += [(1000 + i, words(r, 20) + t[30:110] + words(r, 20)) for i, t in items[:20]] + [(2000, words(r, 300)), (2001, None), (2002, "")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([*items, (900, None), (901, "short")], "item_id long, text string").write.parquet(f"{tmp_path}/heldout_item.parquet")
    got = {(p["doc_id"], p["item_id"]): (p["edits"], p["run"]) for p in entry.queries()["p8_passages"](spark, str(tmp_path)).collect()}
    assert all(d % 1000 == i for d, i in got)
    assert sum(d < 1000 for d, _ in got) >= 0.9 * len(items)
    assert all(1 <= e <= 4 and n < 60 for (d, _), (e, n) in got.items() if d < 1000)
    whole = {p for p, (e, n) in got.items() if n >= 60}
    assert whole == {(1000 + i, i) for i in range(20)} == {tuple(p) for p in entry.queries()["p8_found"](spark, str(tmp_path)).collect()}
    assert all(got[p][0] == 0 for p in whole)


@pytest.mark.parametrize("moved", [False, True, None])
def test_recall_of_windows_the_walk_has_not_seen(moved):
    """Letters changed, letters lost or added as well, and (None) every tenth letter changed: the samples that are taken hold for windows of another seed."""
    walk = for_recall(Walk(steps=72, sample=12), 4, 0.9)
    rng = np.random.default_rng(77)
    a = rng.integers(97, 123, (2000, 40)).astype(np.uint32)
    b = np.array([edited(x, 4, rng, moved) for x in a]) if moved is not None else np.where(np.arange(40) % 10 == np.arange(2000)[:, None] % 10, 48, a).astype(np.uint32)
    at = np.arange(2000) * 40
    assert (keys(a.ravel(), at, walk) == keys(b.ravel(), at, walk)).any(axis=0).mean() >= 0.88


def test_distances_of_many():
    rng = np.random.default_rng(5)
    for size, most in ((40, 4), (12, 1), (5, 0), (3, 4)):
        x = rng.integers(97, 100, (300, size)).astype(np.uint32)
        y = np.array([edited(row, int(rng.integers(0, 7)), rng) for row in x])
        assert _distances(x, y, most).tolist() == [_distance(text_of(p), text_of(q), most) for p, q in zip(x, y, strict=True)]


def test_passages_of_empty_tables(spark):
    none, some = spark.createDataFrame([], "d long, t string"), spark.createDataFrame([(1, "abc" * 40)], "d long, t string")
    assert passages(none, some.toDF("i", "t"), "d", "t", "i", "t").count() == passages(some, none.toDF("i", "t"), "d", "t", "i", "t").count() == 0

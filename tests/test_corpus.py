from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quireframe.errors import UserError
from quireframe.functions.tokenise import any_words, parse_query
from quireframe.operators import clusters as cl
from quireframe.operators import concordance as cc
from quireframe.operators import corpora as co
from quireframe.operators import footers as fo
from quireframe.operators import intervals as iv
from quireframe.operators import keyness as ke
from quireframe.operators import kwic as kw
from quireframe.operators import store as st
from quireframe.operators import subsets as su
from quireframe.operators import tags as tg
from quireframe.operators.importing import annotate
from quireframe.schema import SUBSETS

EDITH = """Edith
Brindle

CHAPTER I. Rain

‘Pity!’ thought Edith to herself, ‘under such a roof as this, I could dream
nothing of climbing rain towers!’ (Which was most likely true.)

Rain, rain, rain. Would the roof never come to an end?

CHAPTER II. Barn

‘Blusterer and blusterer!’ cried Edith.
"""
HERRING = """Herring
Marlowe

CHAPTER I. Storm

The Crow had been fishing most days. ‘Keep up!’ said an elderly badger, ‘at the elm, you know.’ The Crow's cousin saw the Crow.
"""


@pytest.fixture(scope="module")
def books(spark):
    t = annotate(spark.createDataFrame([(1, "edith", EDITH), (2, "herring", HERRING), (3, "none", None)], "book_id long, name string, content string"))
    return {k: v.cache() for k, v in t.items()}


def test_annotated(books, rows):
    tok = books["token"]
    assert tok.where("book_id = 2").orderBy("ordering").limit(6).agg(F.array_join(F.collect_list("ttype"), " ")).first()[0] == "herring marlowe chapter i storm the"
    assert tok.where("book_id = 3").count() == 0
    for r in tok.join(books["book"], "book_id").collect():
        word = r["content"][r["tok_start"] : r["tok_end"]].lower().replace("’", "'")
        assert word.strip("_") == r["ttype"]
    assert rows(books["book_metadata"].where("rclass_id = 101").select("book_id", "content")) == [(1, "Edith"), (2, "Herring")]
    assert {r["book_id"]: r["n"] for r in tok.groupBy("book_id").agg(F.max("ordering").alias("n")).collect()} == {r["book_id"]: r["n"] for r in tok.groupBy("book_id").agg(F.count("*").alias("n")).collect()}


def test_counts_agree(books, rows):
    counts = {r["book_id"]: r for r in su.counts(books["token"], SUBSETS).collect()}
    by = {(r["book_id"], r["rclass_id"]): r["n"] for r in books["book_word_count"].groupBy("book_id", "rclass_id").agg(F.sum("word_count").alias("n")).collect()}
    for b, r in counts.items():
        for name, c in SUBSETS.items():
            assert r[name] == by.get((b, c), 0)


def test_clusters_have_holes(books, rows):
    got = dict(rows(cl.word_list(books["token"], [301], 2)))
    assert got["the crow"] == 2 and got["the crow's"] == 1 and got["rain rain"] == 2
    assert "end chapter" not in got and "end blusterer" not in got
    quote = dict(rows(cl.word_list(books["token"], [501], 2)))
    assert "pity under" not in quote and quote["keep up"] == 1
    total = sum(dict(rows(cl.word_list(books["token"], [301], 1))).values())
    assert total == books["token"].where(st.in_class(301)).count()
    with pytest.raises(NotImplementedError):
        cl.word_list(books["token"], [301, 501])


@pytest.mark.parametrize("n, block", [(2, 3), (3, 4), (7, 2)])
def test_blocks_change_nothing(books, rows, monkeypatch, n, block):
    whole = rows(cl.ngrams(books["token"], 301, n))
    monkeypatch.setattr(cl, "blocked", lambda *a: st.blocked(*a, block=block))
    assert rows(cl.ngrams(books["token"], 301, n)) == whole and whole


def test_published_log_likelihood(spark):
    data = [("hand", 540, 7525, 534.64), ("hands", 227, 3635, 183.53), ("forehead", 29, 504, 20.50), ("head", 431, 5892, 437.88), ("neck", 16, 650, 0.32), ("zero", 540, 0, 4180.78)]
    df = spark.createDataFrame(data, "t string, a long, b long, x double")
    got = df.select("t", "x", F.round(ke.log_likelihood(F.col("a"), F.col("b"), F.lit(116000), F.lit(5451382)), 2).alias("ll"))
    assert all(r["x"] == r["ll"] for r in got.collect())


def test_keywords(spark):
    a = spark.createDataFrame([("one", 540), ("two", 2), ("three", 29), ("four", 431), ("five", 16)], "ngram string, freq long")
    b = spark.createDataFrame([("one", 540), ("two", 227), ("three", 29), ("four", 431), ("SIX", 16)], "ngram string, freq long")
    more = a.unionByName(spark.createDataFrame([("rest", 10)], a.schema))
    got = ke.keywords(a, b, 1.0, exclude_underused=False)
    assert {r["type"] for r in got.collect()} == {"one", "three", "four", "five"}
    assert got.where("type = 'five'").first()["count_ref"] == 0
    assert got.first()["total_analysis"] == 1018
    assert ke.keywords(more, b, 1.0, False, cutoff=30).count() == 2 and ke.keywords(a, b, 1.0, False, limit=2).count() == 2
    assert ke.keywords(a.limit(0), b).count() == 0 and ke.keywords(a, b.limit(0)).count() == 0


def lines(df):
    return sorted((r["book_id"], r["start"], r["end"], [t["ttype"] for t in r["left"]], [t["ttype"] for t in r["node"]], [t["ttype"] for t in r["right"]]) for r in df.collect())


def test_concordance_against_scan(books):
    tok = books["token"].orderBy("book_id", "ordering").collect()
    import re

    for q, subset, k in (("the crow*", "all", 2), ("* rain", "all", 3), ("k?ep up", "quote", 0), ("said * elderly", "nonquote", 40)):
        pats = [re.compile("".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in p) + "$") for p in parse_query(q)]
        expected = []
        for b in (1, 2):
            t = [x for x in tok if x["book_id"] == b]
            for i in range(len(t) - len(pats) + 1):
                node = t[i : i + len(pats)]
                if all(p.match(x["ttype"]) and SUBSETS[subset] in (x["part_of"] or {}) for p, x in zip(pats, node)):
                    expected.append((b, node[0]["tok_start"], node[-1]["tok_end"], [x["ttype"] for x in t[max(0, i - k) : i]], [x["ttype"] for x in node], [x["ttype"] for x in t[i + len(pats) : i + len(pats) + k]]))
        assert lines(cc.concordance(books["token"], [q], [SUBSETS[subset]], k)) == sorted(expected) and expected


def test_concordance_errors_and_bag(books):
    with pytest.raises(UserError):
        cc.concordance(books["token"], [], [301])
    with pytest.raises(UserError):
        cc.concordance(books["token"], ["x"], [301, 501])
    with pytest.raises(UserError):
        cc.concordance(books["token"], ["!!!"], [301])
    assert cc.concordance(books["token"], ["crow", "cr*"], [301]).where("book_id = 2").count() == 2 + 3


def test_windows():
    text = 'A man walked into a bar. "Ouch!", he said'
    at = lambda w, i=0: (text.index(w, i), text.index(w, i) + len(w))
    toks = [at("A"), at("man"), at("walked"), at("into"), at("a", 17), at("bar")]
    got = cc.windows(text, 0, toks, 1, 3)
    assert got == {"left": {"parts": ["A", " "], "words": [0]}, "node": {"parts": ["man", " ", "walked", " ", "into"], "words": [0, 2, 4]}, "right": {"parts": [" ", "a", " ", "bar"], "words": [1, 3]}}
    toks = [at("a", 17), at("bar"), at("Ouch!"), at("he", 30), at("said")]
    got = cc.windows(text, 0, toks, 2, 1)
    assert got["left"]["parts"] == ["a", " ", "bar", ".", " "] and got["node"] == {"parts": ['"', "Ouch!", '",'], "words": [1]} and got["right"]["parts"] == [" ", "he", " ", "said"]


def test_line_text(books):
    got = cc.with_text(cc.concordance(books["token"], ["elderly badger"], [301], 2), books["book"]).first()
    assert "".join(got["left"]["parts"]) == "said an " and "".join(got["node"]["parts"]) == "elderly badger," and "".join(got["right"]["parts"]) == " ‘at the"


def test_subset_listing(books):
    got = {tuple(t["ttype"] for t in r["node"]): r for r in su.listing(books["token"], st.regions(books["text_region"]), [501], 2).collect()}
    r = got[("keep", "up")]
    assert [t["ttype"] for t in r["right"]] == ["said", "an", "elderly"] and r["chapter"] == 1
    with pytest.raises(UserError):
        su.listing(books["token"], books["text_region"], [])


def test_footers(books, rows):
    reg = st.regions(books["text_region"])
    starts = {(r["book_id"], r["chapter"]): r["start"] for r in fo.chapter_starts(reg).collect()}
    assert starts[(1, "1")] == EDITH.index("‘Pity") and starts[(1, "2")] == EDITH.index("‘Blusterer") and starts[(1, "_end")] == len(EDITH.rstrip())
    before = {(r["book_id"], r["chapter"]): r["words"] for r in fo.words_before(books["book_word_count"]).collect()}
    assert before[(1, "1")] == 0 and before[(1, "_end")] == before[(1, "2")] + 5
    assert set(fo.footer(["book_titles", "chapter_start", "word_count_chapter", "word_count_quote"], reg, books["book_word_count"], books["book_metadata"])) == {"book_titles", "chapter_start", "word_count_chapter", "word_count_quote"}
    with pytest.raises(ValueError):
        fo.footer(["nonsense"], reg, books["book_word_count"], books["book_metadata"])


def test_corpora(spark, books, rows):
    corpus = spark.createDataFrame([(1, "zcorp", "Z", None, 0), (2, "acorp", "A", bytearray(b"jpg"), 1), (3, "empty", "E", None, 2)], "corpus_id int, name string, title string, carousel_image binary, ordering int")
    links = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (2, 2)], "corpus_id int, book_id long")
    listing = co.listing(corpus, links, books["book"], books["book_metadata"])
    assert [(r["corpus_name"], [c["id"] for c in r["children"]]) for r in co.nested_listing(listing).collect()] == [("zcorp", ["edith", "herring"]), ("acorp", ["herring"])]
    assert rows(co.books_per_author(listing)) == [("Brindle", 1), ("Marlowe", 2)]
    heads = {r["name"]: (r["book_count"], r["word_count"]) for r in co.headlines(corpus, links, books["book_word_count"]).collect()}
    assert heads["zcorp"][0] == 2 and heads["acorp"][0] == 1 and "empty" not in heads and heads["zcorp"][1] > heads["acorp"][1] > 0
    assert bytes(co.image(corpus, "corpus:acorp").first()["image"]) == b"jpg"
    resolve = lambda *s: sorted(r["book_id"] for r in co.resolve(s, corpus, links, books["book"], books["book_metadata"], {"old": ["corpus:zcorp"]}).collect())
    assert resolve("edith", 1) == [1] and resolve("old", "author:Marlowe") == [1, 2] and resolve("corpus:acorp") == [2] and resolve("nobody") == []
    with pytest.raises(UserError):
        resolve()


def test_complement(spark, rows):
    make = lambda r: spark.createDataFrame([(1, a, z) for a, z in r], "k long, r_start int, r_end int")
    length = spark.createDataFrame([(1, 100)], "k long, length int")
    for given, outer, inner in (([], [(0, 100)], []), ([(10, 20), (50, 60)], [(0, 10), (20, 50), (60, 100)], [(20, 50)]), ([(0, 0), (10, 15), (15, 20), (50, 50)], [(0, 10), (20, 50), (50, 100)], [(0, 10), (20, 50)])):
        assert [r[1:] for r in rows(iv.complement(make(given), ["k"], length))] == outer
        assert [r[1:] for r in rows(iv.complement(make(given), ["k"]))] == inner


def test_segments_and_trim(spark, rows):
    df = spark.createDataFrame([(1, "a", 0, 10), (1, "b", 5, 15), (1, "a", 8, 12), (1, "c", 20, 25), (1, "c", 3, 3)], "k long, l string, r_start int, r_end int")
    assert rows(iv.segments(df, "k", "l")) == [(1, 0, 5, ["a"]), (1, 10, 12, ["a", "b"]), (1, 12, 15, ["b"]), (1, 20, 25, ["c"]), (1, 5, 8, ["a", "b"]), (1, 8, 10, ["a", "b"])]
    t = spark.createDataFrame([("  ab  ", 0, 6), ("   ", 0, 3)], "t string, r_start int, r_end int")
    assert rows(iv.trimmed(t, "t")) == [("  ab  ", 2, 4)]


def test_kwic(spark, rows):
    assert kw.span("-3:2") == ((1, 3), (1, 2)) and kw.span("-5:-2") == ((2, 5), None) and kw.span("2:4") == (None, (2, 4))
    df = spark.createDataFrame([(1, ["you", "are", "the"], ["aren't", "capable", "the"])], "b long, l array<string>, r array<string>")
    s = lambda terms, span: df.select(kw.score(F.col("l"), F.col("r"), terms, span)).first()[0]
    assert s(["Aren't"], "-3:3") == 1 and s(["the"], "-3:3") == 1 and s(["the", "you", "no"], "-3:0") == 2 and s(["the"], "2:2") == 0 and s(["capable"], "2:2") == 1
    assert df.select(kw.positions(F.col("r"), ["the", "aren't"], 2, 5)).first()[0] == [3]
    assert df.select(kw.sort_key(F.col("l"), True), kw.sort_key(F.col("r"))).first()[:] == ("the:are:you:", "aren't:capable:the:")
    assert df.select(kw.node_score(F.col("r"), ["the"], 1), kw.node_score(F.col("r"), ["the"], 1, True)).first()[:] == (0, 1)
    assert spark.range(1).select(kw.per_million(F.lit(2), F.lit(5555)), kw.share(F.lit(3), F.lit(5555))).first()[:] == (360.04, 0.05)
    assert df.select(kw.paragraph_marks(F.lit("a\n\n\nb\nc"))).first()[0] == "a¶ b c"
    assert rows(kw.row_filter(df.select("b", F.array_join("l", " ").alias("l")), ["b", "l"], "ARE T")) == [(1, "you are the")]


def test_tags(spark, rows):
    assert tg.unique_name("e", ["e", "e-1"]) == "e-2" and tg.unique_name("12", []) == "n12"
    own = spark.createDataFrame([("e", "r1"), ("e", "r2"), ("f", "r1")], "tag string, row_id string")
    other = spark.createDataFrame([("e", "r3"), ("g", "r3")], "tag string, row_id string")
    merged, names = tg.merge(own, other, ["e", "f"], ["e", "g"])
    assert names == ["e", "f", "e-1", "g"] and ("e-1", "r3") in rows(merged)
    sel = lambda *r: spark.createDataFrame([(x,) for x in r], "row_id string")
    assert rows(tg.states(own, sel("r1", "r2"), ["e", "f", "x"])) == [("e", "yes"), ("f", "mix"), ("x", "no")]
    assert rows(tg.states(own, sel("r1").limit(0), ["e"])) == [("e", "mix")]
    wide = tg.add_columns(sel("r1", "r9"), own, ["e", "f"])
    assert rows(wide) == [("r1", True, True), ("r9", False, False)] and rows(tg.to_rows(wide)) == [("e", "r1"), ("f", "r1")]
    assert rows(tg.toggle(own, sel("r2"), "e", False)) == [("e", "r1"), ("f", "r1")] and ("f", "r2") in rows(tg.toggle(own, sel("r2"), "f", True))
    assert {r[0] for r in rows(tg.rename(own, "e", "z"))} == {"z", "f"} and rows(tg.drop(own, "e")) == [("f", "r1")]


def test_any_words():
    assert any_words(" the  ! fog - ") == ["the", "fog"]

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from quireframe.functions.breaks import boundaries, suppressions
from quireframe.functions.tokenise import anchor, parse_query, tokenise
from quireframe.operators.importing import annotate, dump, load, put_corpora, save, set_version, versions
from quireframe.operators.tagging import tag
from quireframe.sources import books as src
from quireframe.sources import legacy, render
from quireframe.sources.export import json_chunks, region_rows, result_csv, saved_table, stream_json, write_regions, write_texts
from quireframe.schema import RCLASSES


@pytest.mark.parametrize(
    "text, types",
    [
        ("Our naïve crew, won’t they s'pose.", "our naive crew won't they s'pose"), ("Only £3.75, and they've 40 miles left.", "only 3.75 and they've 40 miles left"), ("rain--all of the worst of the mid-week--again", "rain all of the worst of the mid-week again"),
        ("two hand-to-mouth years", "two hand-to-mouth years"), ("'twas 6 weeks' rest. 'zqinvented-name", "'twas 6 weeks' rest zqinvented-name"), ("Take ’em. Leave ‘em.", "take 'em leave em"), ("the _raconteur_.", "the raconteur"), ("", ""), ("hush", "hush"),
    ],
)
def test_tokens(text, types):
    assert " ".join(t for t, _, _ in tokenise(text)) == types


def test_token_offsets_and_queries():
    assert list(tokenise('We met "Jo"', 500)) == [("we", 500, 502), ("met", 503, 506), ("jo", 508, 510)]
    assert parse_query("Cl* * up*-hill p_t") == ["cl%", "%", "up%-hill", "p\\_t"] and parse_query("At the ?nd corner") == ["at", "the", "_nd", "corner"]
    assert [anchor(p.split()) for p in ("our calculation", "sailing west", "the gale", "amy that", "he was this", "so l%ps", "tall l%ps")] == [1, 0, 1, 0, 2, 1, 0]


def test_sentence_rules(spark):
    cut = lambda t, *a: [t[i:j].strip() for i, j in zip([0, *boundaries(t, *a)], [*boundaries(t, *a), len(t)])]
    assert cut("Mr. Oliver came. He left!  “Why?” she said. 3.5 or so, e. g. this.\nAnd then") == ["Mr. Oliver came.", "He left!", "“Why?”", "she said.", "3.5 or so, e. g. this.", "And then"]
    assert cut("It was etc. and so on. U.S.A. is. A") == ["It was etc. and so on.", "U.S.A. is.", "A"]
    assert "Mr." in suppressions(spark) and cut("No Mr. X here. Yes.", suppressions(spark)) == ["No Mr. X here.", "Yes."]


def icu(spark, kind, text):
    """Boundaries by the Unicode library among Spark's own."""
    jvm = spark._jvm.com.ibm.icu
    it = getattr(jvm.text.BreakIterator, f"get{kind}Instance")(jvm.util.ULocale("en_GB@ss=standard"))
    it.setText(text)
    out = []
    while (b := it.next()) != -1:
        out.append(b)
    return out


def test_against_icu(spark):
    from quireframe.functions.tokenise import segments

    text = (
        "“Thou find’st it out, child?  Ay, ’tis worth all; is it not?  That fever never left\nme. A man can’t (in your foggy\nmeadows) see.” ‘Well!’ said Mr. Oliver, No. 5 at 3.5 p.m. etc. and so on. "
        "The U.S.A. is far... too far! Is it?! No, e.g. X. Etc. Mrs. Moss said: “Yes.” “No.” (So. There.) day--one café naïve über-alles 'em.\n\nNext para\n\n「これは。」「それ。」 Конец. И вот? да! Τέλος. Ναι"
    )
    assert [z for _, z in segments(text)] == icu(spark, "Word", text) or set(icu(spark, "Word", text)) ^ {z for _, z in segments(text)} <= {i for i, c in enumerate(text, 1) if c in "'’これはそ"}
    flat = text.replace("\n\n", "\0").replace("\n", " ").replace("\0", "\n\n")
    begins = lambda cuts: {i + len(text[i:]) - len(text[i:].lstrip()) for i in cuts} - {len(text)}
    assert begins(boundaries(text, suppressions(spark))) == begins(icu(spark, "Sentence", flat))


def regions(text, *names):
    return sorted((k, *r) for k, rs in tag(text.strip()).items() for r in rs if k in names)


def test_chapters():
    text = """
Bees of the North
Q Z Larkspur

Opening words. More of them.

INTRODUCTION.

One thing. Another!

A last.

BOOK 2.

Further.

CHAPTER II. Blank

CHAPTER III. On hives

Close
"""
    t = text.strip()
    at = lambda s: (t.index(s), t.index(s) + len(s))
    got = regions(text, "metadata.title", "metadata.author", "chapter.part", "chapter.title", "chapter.text")
    assert got == sorted([
        ("metadata.title", *at("Bees of the North"), None), ("metadata.author", *at("Q Z Larkspur"), None), ("chapter.part", *at("BOOK 2."), 1), ("chapter.title", *at("INTRODUCTION."), 1), ("chapter.title", *at("CHAPTER II. Blank"), 2), ("chapter.title", *at("CHAPTER III. On hives"), 3),
        ("chapter.text", *at("Opening words. More of them."), 0), ("chapter.text", *at("One thing. Another!\n\nA last."), 1), ("chapter.text", *at("Further."), 1), ("chapter.text", *at("Close"), 3),
    ])
    assert [r[3] for r in regions(text, "chapter.sentence")] == [1, 2, 1, 2, 3, 1, 1] and [r[3] for r in regions(text, "chapter.paragraph")] == [1, 1, 2, 1, 1]


@pytest.mark.parametrize(
    "text, expected",
    [
        ('"Snow," she cried, "on the \'grand old tower\'."', [("quote.nonquote", "she cried,"), ("quote.quote", '"Snow,"'), ("quote.quote", '"on the \'grand old tower\'."'), ("quote.suspension.short", "she cried,")]),
        ('Those "silver spoons" proved to be tin.\n"Just three words" "These make five of them"', [("quote.nonquote", 'Those "silver spoons" proved to be tin.\n"Just three words"'), ("quote.quote", '"These make five of them"')]),
        ("'Now listen', they told us, 'for it rings,'", [("quote.nonquote", "'Now listen', they told us,"), ("quote.quote", "'for it rings,'")]),
        ("“Well, good night!” or, “When shall we meet!”", [("quote.nonquote", "or,"), ("quote.quote", "“Well, good night!”"), ("quote.quote", "“When shall we meet!”"), ("quote.suspension.short", "or,")]),
        ("‘Yes, do come in!’ the porter said quite gravely; ‘we don’t bite here. The\ncook may, now and then.’", [("quote.nonquote", "the porter said quite gravely;"), ("quote.quote", "‘Yes, do come in!’"), ("quote.quote", "‘we don’t bite here. The\ncook may, now and then.’"), ("quote.suspension.long", "the porter said quite gravely;")]),
        ("“A speech starts,\n\n“and runs into this.” Later, ‘We heard, “Ada and\nBertram lost it,” so,’ they went", [("quote.embedded", "“Ada and\nBertram lost it,”"), ("quote.nonquote", "Later,"), ("quote.nonquote", "they went"), ("quote.quote", "“A speech starts,\n\n“and runs into this.”"), ("quote.quote", "‘We heard, “Ada and\nBertram lost it,” so,’")]),
        ("garden”--(“Oh! if he had only known, then!”)--“but was at his desk.”", [("quote.nonquote", "garden”--("), ("quote.nonquote", ")--"), ("quote.quote", "“Oh! if he had only known, then!”"), ("quote.quote", "“but was at his desk.”")]),
    ],
)
def test_speech(text, expected):
    got = regions(text, "quote.quote", "quote.nonquote", "quote.embedded", "quote.suspension.short", "quote.suspension.long")
    assert sorted((k, text[a:z]) for k, a, z, _ in got) == sorted(expected)


def test_given_regions_stand():
    from quireframe.operators.tagging import Region

    got = tag("One. Two.", {"chapter.sentence": [Region(0, 9, 1)]})
    assert got["chapter.sentence"] == [Region(0, 9, 1)] and got["chapter.text"] == [Region(0, 9, 0)]


TEXT = "Maud\nBrindle\n\nCHAPTER I. Away\n\n‘Well!’ thought Maud, ‘after such a ride.’\n"
BIB = """
@book{a, title = {Winter Voyages}, shorttitle = {voyages}, keywords = {{Extra}} }
@book{c, title = {Tales {Retold}}, shorttitle = {{Tales}}, number = {3}, keywords = {corpus} }
@book{d, title = {Further Texts}, shorttitle = {{Extra}}, number = {4}, keywords = {corpus} }
@book{e, title = "Heron", shorttitle = {heron}, keywords = {{Extra},{Tales}} }
"""


def test_files_round_trip(spark, tmp_path, rows):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "maud.txt").write_text(TEXT)
    (tmp_path / "in" / "other.txt").write_text("No head here.")
    (tmp_path / "maud.regions.csv").write_text("chapter.text,31,73,1,x\nignore.italics,0,1,,\nquote.quote,31,38,,‘Well!’\n")
    books = src.read_books(spark, str(tmp_path / "in"))
    assert rows(books.select("name", "content")) == [("maud", TEXT), ("other", "No head here.")]
    side = src.read_regions(spark, str(tmp_path / "maud.regions.csv"))
    assert rows(side) == [("maud", "chapter.text", 31, 73, 1), ("maud", "quote.quote", 31, 38, None)]
    t = annotate(src.with_given(books, side))
    assert t["text_region"].where("rclass_id = 501").count() == 1
    write_regions(region_rows(t["text_region"], books, RCLASSES), str(tmp_path / "side"))
    again = spark.read.schema(src.SIDECAR).csv(str(tmp_path / "side"))
    assert again.where("rclass = 'quote.quote'").first()[:3] == ("quote.quote", 31, 38)
    write_texts(books, str(tmp_path / "out"))
    assert {r[0] for r in rows(spark.read.text(str(tmp_path / "out"), wholetext=True).select("value"))} == {TEXT, "No head here.\n"}
    (tmp_path / "bad.regions.csv").write_text("nonsense,0,1,,\n")
    with pytest.raises(Exception, match="Unknown region class"):
        src.read_regions(spark, str(tmp_path / "bad.regions.csv")).collect()


def test_catalogue(spark, tmp_path, rows):
    (tmp_path / "corpora.bib").write_text(BIB)
    (tmp_path / "images").mkdir()
    (tmp_path / "images" / "Tales_0.4.jpg").write_bytes(b"JPEG!")
    corpora, links = src.read_catalogue(spark, str(tmp_path / "corpora.bib"))
    assert rows(corpora) == [("Extra", "Extra - Further Texts", "", 4), ("Tales", "Tales - Tales Retold", "", 3)]
    assert rows(links) == [("Extra", "heron"), ("Extra", "voyages"), ("Tales", "heron")]
    images = {r["name"]: r["carousel_image"] for r in src.with_images(corpora, str(tmp_path / "images")).collect()}
    assert bytes(images["Tales"]) == b"JPEG!" and images["Extra"] is None
    assert rows(src.corpora_for(links, src.uploaded(spark, "voyages", "x"))) == [("Extra",)]
    book = src.uploaded(spark, "voyages", "x").unionByName(src.uploaded(spark, "heron", "y"))
    put_corpora(corpora, links, book, str(tmp_path / "store"))
    assert spark.read.parquet(str(tmp_path / "store/corpus_book")).count() == 3
    with pytest.raises(Exception, match="heron"):
        put_corpora(corpora, links, book.where("name = 'voyages'"), str(tmp_path / "store"))


def test_store_replaces_books(spark, tmp_path, rows):
    path = str(tmp_path / "store")
    both = src.uploaded(spark, "a", TEXT).unionByName(src.uploaded(spark, "b", "Some words. More."))
    save(annotate(both), path)
    n = load(spark, path)["token"].groupBy("book_id").count().count()
    save(annotate(src.uploaded(spark, "b", "Now another text here.")), path)
    t = load(spark, path)
    assert n == 2 and rows(t["book"].select("name", "content")) == [("a", TEXT), ("b", "Now another text here.")]
    assert rows(t["token"].join(t["book"], "book_id").where("name = 'b'").select("ttype")) == [("another",), ("here",), ("now",), ("text",)]
    save(annotate(src.uploaded(spark, "b", "…")), path)
    t = load(spark, path)
    assert t["token"].join(t["book"], "book_id").where("name = 'b'").count() == 0
    set_version(spark, path, "corpora", "db61de3")
    set_version(spark, path, "importer", "2")
    assert rows(versions(spark, path)) == [("corpora", "db61de3"), ("importer", "2")]
    dump(spark, path, str(tmp_path / "copy"))
    assert load(spark, str(tmp_path / "copy"))["book"].count() == 2


def test_stream(spark, tmp_path, rows):
    from quireframe.streaming.books import follow

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text(TEXT)
    for text in (None, "Later text."):
        if text:
            (tmp_path / "in" / "b.txt").write_text(text)
        follow(spark, str(tmp_path / "in"), str(tmp_path / "store"), str(tmp_path / "cp"), once=True).awaitTermination(120)
    assert rows(load(spark, str(tmp_path / "store"))["book"].select("name")) == [("a",), ("b",)]


def test_results_round_trip(spark, tmp_path, rows):
    df = spark.createDataFrame([('say "hi"', "a\n\nb\nc", True)], "x string, `node` string, `tag:t` boolean")
    result_csv(df, str(tmp_path / "t"), "v1", "http://x/?q=1")
    back, url = saved_table(spark, str(tmp_path / "t"))
    assert url == "http://x/?q=1" and rows(back) == [('say "hi"', "a¶ b c", "true")]
    got = json.loads("".join(stream_json(spark.sql("select 1L as n, 'a' as t"), {"info": 1}, {"foot": 2})))
    assert got == {"info": 1, "data": [["1", "a"]], "foot": 2}
    assert json.loads("".join(json_chunks([]))) == {"data": []}

    def broken():
        yield (1,)
        raise ValueError("later")

    assert json.loads("".join(json_chunks(broken())))["error"]["message"] == "ValueError: later"
    with pytest.raises(ValueError):
        list(json_chunks([], header=[]))


def test_legacy_and_rendering(spark, rows):
    markup = '<div id="b.1" book="moon" type="chapter" num="1"><title>I. Start</title><p pid="1"><s sid="1"><qs wordOffset="0"/>"Hi,"<qe wordOffset="1"/> <sss />he said,<sse /> </s></p></div>'
    name, text, found = legacy.convert(markup, 10)
    assert name == "moon" and text.startswith("\n\n\nCHAPTER I. Start")
    by = {k: (text[a - 10 : z - 10], v) for k, a, z, v in found}
    assert by["chapter.title"] == ("CHAPTER I. Start", 1) and by["quote.quote"][0] == '"Hi,"' and by["quote.suspension.short"][0] == "he said," and by["chapter.sentence"][1] == 1
    with pytest.raises(ValueError):
        legacy.convert("<bogus>x")
    df = spark.createDataFrame([("T", "A", [markup])], "title string, author string, chapters array<string>")
    assert legacy.convert_books(df).first()["name"] == "moon"
    assert [p for p in render.pieces("abcdef", {"x": [(0, 3)], "y": [(2, 5)]})] == [("ab", ("x",)), ("c", ("x", "y")), ("de", ("y",)), ("f", ())]
    assert render.spans("a<b", {"quote.quote": [(0, 1)]}) == '<span class="quote-quote">a</span>&lt;b' and "\x1b[31m" in render.ansi("ab", {"quote.quote": [(0, 1)]})


def test_portable_tokens(spark, rows):
    from quireframe.functions.tokenise import portable_tokens

    df = spark.createDataFrame([(1, "It’s 3.5, a-b!"), (2, None)], "d long, t string")
    assert rows(portable_tokens(df, "d", "t").orderBy("position")) == [(1, 1, "it’s"), (1, 2, "3.5"), (1, 3, "a-b")]
    assert df.select(F.col("d")).count() == 2

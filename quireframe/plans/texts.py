"""Queries of text operators on texts of their own, whose rows are stated by hand as SQL values.

SQL has no word rules, taggers or files, so each of these runs an operator over a small text made for its rules and is
held against rows that were worked out from the rules. The same operators run over all whole books in ``exact_tokens``,
``tagged_regions``, ``conc_texts`` and ``region_previews``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireframe import api
from quireframe.errors import UserError, as_header
from quireframe.functions.tokenise import any_words, parse_query, to_type, token_table
from quireframe.operators import concordance as cc
from quireframe.operators import footers as fo
from quireframe.operators import importing as im
from quireframe.operators import kwic as kw
from quireframe.operators import subsets as su
from quireframe.operators.store import region_text
from quireframe.operators.tagging import tag_books
from quireframe.schema import RCLASSES
from quireframe.session import ensure_checkpoint_dir
from quireframe.sources import books as src
from quireframe.sources import export as ex
from quireframe.sources import legacy, render

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def stated(columns: str, rows: Sequence[tuple]) -> Callable[[Query], Query]:
    """Registers a query with the rows it must give."""

    def text(x) -> str:
        return "NULL" if x is None else str(x).upper() if isinstance(x, bool) else str(x) if isinstance(x, int) else "'" + str(x).replace("'", "''") + "'"

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        names = [c.split()[0] for c in columns.split(", ")]
        casts = ", ".join(f"CAST({c.split()[0]} AS {c.split()[1]}) AS {c.split()[0]}" for c in columns.split(", "))
        values = ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows)
        SQL[f.__name__] = f"SELECT {casts} FROM (VALUES {values}) t({', '.join(names)})"
        return f

    return add


def _books(spark: SparkSession, *texts: str) -> DataFrame:
    return spark.createDataFrame([(i, f"book{i}", t) for i, t in enumerate(texts, 1)], "book_id long, name string, content string")


def _folder(spark: SparkSession) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/texts-{uuid.uuid4().hex}"


def _put(spark: SparkSession, path: str, content: bytes) -> None:
    """A file in any file system that Spark knows."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(content))
    out.close()


# ---- words ----------------------------------------------------------------------------------------------------------


@stated(
    "book_id BIGINT, tok_start INT, tok_end INT, ttype VARCHAR",
    [
        (1, 0, 5, "naive"), (1, 6, 11, "zoe's"), (1, 12, 16, "cost"), (1, 18, 22, "3.75"),
        (2, 0, 5, "'twas"), (2, 6, 7, "6"), (2, 8, 14, "weeks'"), (2, 15, 19, "rest"), (2, 22, 23, "q"),
        (3, 0, 13, "hand-to-mouth"), (3, 15, 18, "mid"), (3, 22, 26, "week"), (3, 27, 30, "'em"),
        (4, 0, 4, "zoon"), (4, 5, 16, "raconteur"), (4, 17, 21, "khaos"), (4, 22, 25, "mir"),
    ],
)
def token_rules(spark: SparkSession, d: str) -> DataFrame:
    """Word rules: apostrophes, hyphens, numbers, accents, underscores, Greek and Cyrillic."""
    texts = ("Naïve Zoë’s cost £3.75", "'Twas 6 weeks' rest. 'Q", "hand-to-mouth (mid--  week ’em.", "Zoön _raconteur_ Χάος мир")
    return token_table(_books(spark, *texts))


@stated("q VARCHAR, patterns VARCHAR", [("Cl* up*-hill p_t", "cl% up%-hill p\\_t"), ("At the ?nd corner", "at the _nd corner"), ("100% Zoë’s", "100 zoe's"), ("!!!", "")])
def query_patterns(spark: SparkSession, d: str) -> DataFrame:
    """Queries as LIKE patterns."""
    asked = ("Cl* up*-hill p_t", "At the ?nd corner", "100% Zoë’s", "!!!")
    return spark.createDataFrame([(q, " ".join(parse_query(q))) for q in asked], "q string, patterns string")


@stated("q VARCHAR, words VARCHAR, types VARCHAR", [("Window ! Lantern", "Window|Lantern", "window lantern"), ("_Aged_ Œuvre", "_Aged_|Œuvre", "aged oeuvre")])
def query_words(spark: SparkSession, d: str) -> DataFrame:
    """Queries for any of their words, and each word's type."""
    return spark.createDataFrame([(q, "|".join(any_words(q)), " ".join(to_type(w) for w in any_words(q))) for q in ("Window ! Lantern", "_Aged_ Œuvre")], "q string, words string, types string")


# ---- taggers --------------------------------------------------------------------------------------------------------

_TAGGED = """Bees of the North
Q Z Larkspur

Opening words. More of them.

BOOK 2. Hives

CHAPTER I. Away

“Snow,” she cried, “on the ‘grand old tower,’ is rare.” The
road was long.

“A speech starts,

“and runs on,” he said without any haste at all, “to here.” Those "silver spoons" were tin."""


def _tagged(spark: SparkSession, classes: Sequence[int]) -> DataFrame:
    book = _books(spark, _TAGGED)
    rows = region_text(book, tag_books(book), list(classes))
    names = F.create_map(*(F.lit(x) for kv in RCLASSES.items() for x in kv))
    return rows.select(F.element_at(names, F.col("rclass_id")).alias("rclass"), F.col("rvalue").alias("value"), "r_start", "content")


@stated(
    "rclass VARCHAR, value INT, content VARCHAR",
    [
        ("metadata.title", None, "Bees of the North"), ("metadata.author", None, "Q Z Larkspur"), ("chapter.part", 1, "BOOK 2. Hives"), ("chapter.title", 1, "CHAPTER I. Away"), ("chapter.text", 0, "Opening words. More of them."),
        ("chapter.text", 1, "“Snow,” she cried, “on the ‘grand old tower,’ is rare.” The\nroad was long.\n\n“A speech starts,\n\n“and runs on,” he said without any haste at all, “to here.” Those \"silver spoons\" were tin."),
    ],
)
def chapter_regions(spark: SparkSession, d: str) -> DataFrame:
    """Title, author, parts, chapters and what lies between."""
    return _tagged(spark, [101, 102, 301, 302, 303]).drop("r_start")


@stated(
    "rclass VARCHAR, value INT, content VARCHAR",
    [
        ("chapter.paragraph", 1, "Opening words. More of them."), ("chapter.paragraph", 1, "“Snow,” she cried, “on the ‘grand old tower,’ is rare.” The\nroad was long."), ("chapter.paragraph", 2, "“A speech starts,"), ("chapter.paragraph", 3, "“and runs on,” he said without any haste at all, “to here.” Those \"silver spoons\" were tin."),
        ("chapter.sentence", 1, "Opening words."), ("chapter.sentence", 2, "More of them."), ("chapter.sentence", 1, "“Snow,” she cried, “on the ‘grand old tower,’ is rare.”"), ("chapter.sentence", 2, "The\nroad was long."), ("chapter.sentence", 3, "“A speech starts,"), ("chapter.sentence", 4, "“and runs on,” he said without any haste at all, “to here.”"), ("chapter.sentence", 5, "Those \"silver spoons\" were tin."),
    ],
)
def paragraph_regions(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs and sentences, numbered in each text."""
    return _tagged(spark, [401, 402]).drop("r_start")


@stated(
    "rclass VARCHAR, content VARCHAR",
    [
        ("quote.quote", "“Snow,”"), ("quote.quote", "“on the ‘grand old tower,’ is rare.”"), ("quote.quote", "“A speech starts,\n\n“and runs on,”"), ("quote.quote", "“to here.”"), ("quote.embedded", "‘grand old tower,’"),
        ("quote.nonquote", "Opening words. More of them."), ("quote.nonquote", "she cried,"), ("quote.nonquote", "The\nroad was long."), ("quote.nonquote", "he said without any haste at all,"), ("quote.nonquote", "Those \"silver spoons\" were tin."),
        ("quote.suspension.short", "she cried,"), ("quote.suspension.long", "he said without any haste at all,"),
    ],
)
def speech_regions(spark: SparkSession, d: str) -> DataFrame:
    """Speech, speech within it, narration and what interrupts speech; two words in straight marks are none."""
    return _tagged(spark, [501, 502, 503, 504, 505]).select("rclass", "content")


# ---- lines with their texts -----------------------------------------------------------------------------------------


@stated("q VARCHAR, left_text VARCHAR, node VARCHAR, right_text VARCHAR", [("old tower", "the ‘grand ", "old tower,’", " is rare"), ("spo*", "Those \"silver ", "spoons\"", " were tin")])
def window_texts(spark: SparkSession, d: str) -> DataFrame:
    """The text around matches, divided into windows."""
    book = _books(spark, _TAGGED)
    token = im.annotate(book)["token"]
    lines = None
    for q in ("old tower", "spo*"):
        some = cc.with_text(cc.concordance(token, [q], [301], 2), book).select(F.lit(q).alias("q"), *(F.concat_ws("", F.col(c)["parts"]).alias(c) for c in ("left", "node", "right")))
        lines = some if lines is None else lines.unionByName(some)
    return lines.withColumnsRenamed({"left": "left_text", "right": "right_text"})


# ---- files, the store and what goes out -----------------------------------------------------------------------------

_STORED = "Maud\nBrindle\n\nCHAPTER I. Away\n\n‘Well!’ thought Maud, ‘after such a ride.’\n"
_SIDE = b"chapter.text,31,73,1,x\nignore.italics,0,1,,\nquote.quote,31,38,,y\n"


@stated("name VARCHAR, rclass VARCHAR, r_start INT, r_end INT, value INT, preview VARCHAR", [("maud", "chapter.text", 31, 73, 1, "‘Well!’ thought Maud...‘after such a ride.’"), ("maud", "quote.quote", 31, 38, None, "‘Well!’")])
def sidecar_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A text and its side-car read, the side-car written and read again; classes to be ignored are left out."""
    at = _folder(spark)
    _put(spark, f"{at}/in/maud.txt", _STORED.encode())
    _put(spark, f"{at}/maud.regions.csv", _SIDE)
    books, side = src.read_books(spark, f"{at}/in"), src.read_regions(spark, f"{at}/maud.regions.csv")
    ids = F.create_map(*(F.lit(x) for k, v in RCLASSES.items() for x in (v, k)))
    reg = side.join(books, "name").select("book_id", F.element_at(ids, F.col("rclass")).alias("rclass_id"), F.col("start").alias("r_start"), F.col("end").alias("r_end"), "rvalue")
    ex.write_regions(ex.region_rows(reg, books, RCLASSES), f"{at}/out")
    again = spark.read.schema(f"{src.SIDECAR}, name string").option("multiLine", True).csv(f"{at}/out")
    return again.select("name", "rclass", F.col("start").alias("r_start"), F.col("end").alias("r_end"), F.col("rvalue").alias("value"), "preview")


@stated("name VARCHAR, content VARCHAR", [("maud", _STORED), ("other", "No end of line\n")])
def text_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Uploaded texts written and read again; a text ends with a line end."""
    at = _folder(spark)
    ex.write_texts(src.uploaded(spark, "maud", _STORED).unionByName(src.uploaded(spark, "other", "No end of line")), f"{at}/out")
    return spark.read.text(f"{at}/out", wholetext=True).select("name", F.col("value").alias("content"))


@stated("step VARCHAR, name VARCHAR, content VARCHAR, tokens BIGINT, quotes BIGINT", [("first", "a", _STORED, 12, 2), ("first", "b", "Some words.", 2, 0), ("replaced", "a", _STORED, 12, 2), ("replaced", "b", "Now another text.", 3, 0), ("copy", "a", _STORED, 12, 2), ("copy", "b", "Now another text.", 3, 0)])
def store_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Books saved, one replaced, the store copied: texts, tokens and speech of each book as they are read back."""
    at = _folder(spark)

    def seen(step: str, path: str) -> DataFrame:
        t = im.load(spark, path)
        of = lambda name, where: t[name].where(where).groupBy("book_id").agg(F.count(F.lit(1)).alias(name))
        rows = t["book"].join(of("token", "true"), "book_id", "left").join(of("text_region", "rclass_id = 501"), "book_id", "left")
        return spark.createDataFrame(rows.select(F.lit(step).alias("step"), "name", "content", F.coalesce("token", F.lit(0).cast("long")).alias("tokens"), F.coalesce("text_region", F.lit(0).cast("long")).alias("quotes")).collect(), "step string, name string, content string, tokens long, quotes long")

    im.save(im.annotate(src.uploaded(spark, "a", _STORED).unionByName(src.uploaded(spark, "b", "Some words."))), f"{at}/store", buckets=4)
    first = seen("first", f"{at}/store")
    im.save(im.annotate(src.uploaded(spark, "b", "Now another text.")), f"{at}/store")
    im.dump(spark, f"{at}/store", f"{at}/copy")
    return first.unionByName(seen("replaced", f"{at}/store")).unionByName(seen("copy", f"{at}/copy"))


@stated("corpus VARCHAR, title VARCHAR, ordering INT, book VARCHAR, image VARCHAR", [("Extra", "Extra - Further Texts", 4, "heron", None), ("Extra", "Extra - Further Texts", 4, "voyages", None), ("Tales", "Tales - Tales Retold", 3, "heron", "JPEG!")])
def catalogue_import(spark: SparkSession, d: str) -> DataFrame:
    """A catalogue of corpora with its links and images, put into a store and read from it."""
    at = _folder(spark)
    bib = '''@book{a, title = {Winter Voyages}, shorttitle = {voyages}, keywords = {{Extra}} }
@book{c, title = {Tales {Retold}}, shorttitle = {{Tales}}, number = {3}, keywords = {corpus} }
@book{d, title = {Further Texts}, shorttitle = {{Extra}}, number = {4}, keywords = {corpus} }
@book{e, title = "Heron", shorttitle = {heron}, keywords = {{Extra},{Tales}} }'''
    _put(spark, f"{at}/corpora.bib", bib.encode())
    _put(spark, f"{at}/images/Tales_0.4.jpg", b"JPEG!")
    corpora, links = src.read_catalogue(spark, f"{at}/corpora.bib")
    book = src.uploaded(spark, "voyages", "x").unionByName(src.uploaded(spark, "heron", "y"))
    im.put_corpora(src.with_images(corpora, f"{at}/images"), links, book, at)
    stored = spark.read.parquet(f"{at}/corpus").withColumnRenamed("name", "corpus")
    rows = stored.join(spark.read.parquet(f"{at}/corpus_book"), "corpus_id").join(book.select("book_id", F.col("name").alias("book")), "book_id")
    return rows.select("corpus", "title", "ordering", "book", F.col("carousel_image").cast("string").alias("image"))


@stated("name VARCHAR, version VARCHAR", [("corpora", "c2"), ("importer", "7")])
def version_table(spark: SparkSession, d: str) -> DataFrame:
    """Versions noted, one of them twice."""
    at = _folder(spark)
    for name, version in (("corpora", "c1"), ("importer", "7"), ("corpora", "c2")):
        im.set_version(spark, at, name, version)
    return im.versions(spark, at)


@stated("x VARCHAR, node VARCHAR, tagged VARCHAR, url VARCHAR", [('say "hi"', "a¶ b c", "true", "http://x/?q=1"), ("plain", "", "false", "http://x/?q=1")])
def result_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A result with a column of tags as CSV, read again with the address of its query."""
    at = _folder(spark)
    rows = spark.createDataFrame([('say "hi"', "a\n\nb\nc", True), ("plain", "", False)], "x string, node string, `tag:t` boolean")
    ex.result_csv(rows, f"{at}/t", "v1", "http://x/?q=1")
    back, url = ex.saved_table(spark, f"{at}/t")
    return back.select("x", F.coalesce("node", F.lit("")).alias("node"), F.col("`tag:t`").alias("tagged"), F.lit(url).alias("url"))


@stated("k VARCHAR, v VARCHAR", [("data", '[["1", "a", "2.50"], [null, "b", "0.10"]]'), ("foot", "[2]"), ("info", '{"message": "m"}')])
def json_answer(spark: SparkSession, d: str) -> DataFrame:
    """A result as one JSON object: header, rows with longs and decimals as text, footer."""
    rows = spark.sql("SELECT * FROM VALUES (1L, 'a', CAST(2.5 AS DECIMAL(5,2))), (NULL, 'b', CAST(0.1 AS DECIMAL(5,2))) AS t(n, s, x)").coalesce(1)
    got = json.loads("".join(ex.stream_json(rows, {"info": {"message": "m"}}, {"foot": [2]})))
    got["data"] = [[None if x == "None" else x for x in r] for r in got["data"]]
    return spark.createDataFrame([(k, json.dumps(v)) for k, v in got.items()], "k string, v string")


@stated("rclass VARCHAR, value INT, content VARCHAR", [("metadata.title", None, "T"), ("metadata.author", None, "A"), ("chapter.title", 1, "CHAPTER I. Start"), ("chapter.text", 1, "\"Hi,\" he said,  "), ("chapter.paragraph", 1, "\"Hi,\" he said,  "), ("chapter.sentence", 1, "\"Hi,\" he said, "), ("quote.quote", None, "\"Hi,\""), ("quote.nonquote", None, " he said,  "), ("quote.suspension.short", None, "he said,")])
def legacy_markup(spark: SparkSession, d: str) -> DataFrame:
    """A chapter in the older mark-up as text and regions."""
    markup = '<div id="b.1" book="moon" type="chapter" num="1"><title>I. Start</title><p pid="1"><s sid="1"><qs wordOffset="0"/>"Hi,"<qe wordOffset="1"/> <sss />he said,<sse /> </s></p></div>'
    rows = legacy.convert_books(spark.createDataFrame([("T", "A", [markup])], "title string, author string, chapters array<string>"))
    each = rows.select("content", F.explode("given").alias("g"))
    return each.select("g.rclass", F.col("g.rvalue").alias("value"), F.substring("content", F.col("g.start") + 1, F.col("g.end") - F.col("g.start")).alias("content"))


@stated("form VARCHAR, shown VARCHAR", [("html", '<span class="quote-quote">a</span>&lt;<span class="chapter-title">b</span>'), ("ansi", "[31ma[0m<[33mb[0m")])
def rendered_regions(spark: SparkSession, d: str) -> DataFrame:
    """Regions shown on a page and, without its control characters, on a terminal."""
    regions = {"quote.quote": [(0, 1)], "chapter.title": [(2, 3)]}
    return spark.createDataFrame([("html", render.spans("a<b", regions)), ("ansi", render.ansi("a<b", regions).replace(chr(27), ""))], "form string, shown string")


# ---- views ----------------------------------------------------------------------------------------------------------


@stated("node VARCHAR, from_start INT, from_end INT, highlight INT, marked VARCHAR", [("the old grey goose", 1, 0, 2, "a¶ b c"), ("goose the", 2, 1, 3, "a¶ b c"), ("", 0, 0, 1, "a¶ b c")])
def node_matches(spark: SparkSession, d: str) -> DataFrame:
    """Terms looked for within a node, from its start or end; the class of the highlight; paragraph marks."""
    rows = spark.createDataFrame([(n, n.split()) for n in ("the old grey goose", "goose the", "")], "node string, w array<string>")
    two = kw.node_score(F.col("w"), ["The", "goose"], 2)
    rows = rows.withColumn("from_start", two).withColumn("from_end", kw.node_score(F.col("w"), ["the", "old"], 2, from_end=True))
    return rows.select("node", "from_start", "from_end", kw.highlight(F.col("from_start")).alias("highlight"), kw.paragraph_marks(F.lit("a\n\nb\nc")).alias("marked"))


@stated("asked VARCHAR, level VARCHAR, message VARCHAR", [("no words", "error", "Nothing to search for"), ("two subsets", "error", "You must supply exactly one subset"), ("unknown item", "error", "ValueError"), ("warning", "warn", "careful"), ("cluster of 8", "error", "Clusters have 1 to 7 words")])
def request_errors(spark: SparkSession, d: str) -> DataFrame:
    """Errors of requests with their levels; those that are not the asker's are told by their kind."""
    token = spark.createDataFrame([], "book_id long, tok_start int, tok_end int, ttype string, ordering int, part_of map<int,int>")
    empty = spark.createDataFrame([], "book_id long, rclass_id int, r_start int, r_end int, rvalue int")

    def warn() -> None:
        raise UserError("careful", "warn")

    asked: dict[str, Callable[[], object]] = {
        "no words": lambda: cc.concordance(token, [], [301]), "two subsets": lambda: cc.concordance(token, ["x"], [301, 501]), "unknown item": lambda: fo.footer(["nonsense"], empty, empty, empty),
        "warning": warn, "cluster of 8": lambda: api.check_view(clusterlength=8),
    }
    rows = []
    for name, ask in asked.items():
        try:
            ask()
        except Exception as e:
            (level, said), = as_header(e).items()
            rows.append((name, level, said["message"] if isinstance(e, UserError) else said["message"].split(":")[0]))
    return spark.createDataFrame(rows, "asked string, level string, message string")


@stated("view VARCHAR, contextsize INT, metadata VARCHAR", [("concordance", 10, "book_titles chapter_start word_count_all"), ("subset", 5, "book_titles chapter_start word_count_all")])
def view_defaults(spark: SparkSession, d: str) -> DataFrame:
    """What the views of a concordance and of a subset begin with."""
    return spark.createDataFrame([(n, v["contextsize"], " ".join(v["metadata"])) for n, v in (("concordance", api.CONCORDANCE_VIEW), ("subset", api.SUBSET_VIEW))], "view string, contextsize int, metadata string")


@stated("query VARCHAR, rows BIGINT", [("drill_down", 1), ("keyword", 1), ("swapped_keyword", 1), ("subset", 2), ("text", 1)])
def public_queries(spark: SparkSession, d: str) -> DataFrame:
    """Public queries over a store of one book: how many rows each gives."""
    tables = im.annotate(_books(spark, _TAGGED))
    tables["corpus"] = spark.createDataFrame([(1, "one", "One", None, 0)], "corpus_id int, name string, title string, carousel_image binary, ordering int")
    tables["corpus_book"] = spark.createDataFrame([(1, 1)], "corpus_id int, book_id long")
    corpus = api.Corpus(tables)
    one = ["corpus:one"]
    key = {"corpora": one, "refcorpora": one, "subset": ["all"], "refsubset": ["quote"], "pvalue": 1.0, "limit": 1}
    back = {**key, "subset": ["quote"], "refsubset": ["all"]}
    counts = [
        ("drill_down", corpus.drill_down("old tower", one).data.count()), ("keyword", min(1, corpus.keyword(1, **key).data.count() + 1)), ("swapped_keyword", min(1, corpus.swapped_keyword(1, **back).data.count() + 1)),
        ("subset", corpus.subset(one, ["shortsus", "longsus"]).data.count()), ("text", corpus.text(one, ["chapter.title"]).data.count()),
    ]
    return spark.createDataFrame(counts, "query string, rows long")


@stated("start INT, left_words VARCHAR, node VARCHAR, right_words VARCHAR", [(102, "snow", "she cried", "on the"), (204, "runs on", "he said without any haste at all", "to here")])
def interruptions(spark: SparkSession, d: str) -> DataFrame:
    """Interruptions of speech with what begins within ten characters on either side."""
    tables = im.annotate(_books(spark, _TAGGED))
    words = lambda c: F.array_join(F.transform(c, lambda t: t["ttype"]), " ")
    return su.listing(tables["token"], tables["text_region"], [503, 504], 1).select("start", words("left").alias("left_words"), words("node").alias("node"), words("right").alias("right_words"))


@stated("shown VARCHAR", [("M\nB\n\nx [31m“Yes, indeed,”[0m y",)])
def region_preview_text(spark: SparkSession, d: str) -> DataFrame:
    """A text tagged and shown with its speech coloured, without the terminal's control characters."""
    return spark.createDataFrame([(api.region_preview("M\nB\n\nx “Yes, indeed,” y", ["quote.quote"]).replace(chr(27), ""),)], "shown string")


@stated("step VARCHAR, noted INT, same BOOLEAN, rows BIGINT", [("first", 1, False, 1), ("again", 1, True, 1), ("other", 2, False, 0), ("warmed", 4, False, 1)])
def session_memory(spark: SparkSession, d: str) -> DataFrame:
    """A reader's session: what is asked is noted with its plan, the last answer is given again, requests are kept warm."""
    tables = im.annotate(_books(spark, _TAGGED))
    tables["corpus"] = spark.createDataFrame([(1, "one", "One", None, 0)], "corpus_id int, name string, title string, carousel_image binary, ordering int")
    tables["corpus_book"] = spark.createDataFrame([(1, 1)], "corpus_id int, book_id long")
    session = api.Session(api.Corpus(tables))
    rows, last = [], None
    for step, words in (("first", "old tower"), ("again", "old tower"), ("other", "new tower")):
        answer = session.ask("concordance", [words], ["corpus:one"])
        rows.append((step, len(session.noted), answer is last, answer.data.count()))
        last = answer
    counts = session.warm([("count", {"corpora": [1]}), ("corpora", {})])
    rows.append(("warmed", len(session.noted), False, counts[0]))
    return spark.createDataFrame(rows, "step string, noted int, same boolean, rows long")

"""Queries over the annotated corpus and their SQL, one for each operator that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireframe.functions.tokenise import PORTABLE, parse_query
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
from quireframe.schema import SUBSETS
from quireframe.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

_TK = "tk AS (SELECT book_id, tok_start, any_value(tok_end) AS tok_end, any_value(ttype) AS ttype, any_value(ordering) AS ordering, any_value(part_of) AS part_of FROM token GROUP BY book_id, tok_start)"
_RG = "rg AS (SELECT book_id, rclass_id, r_start, r_end, max(rvalue) AS rvalue FROM text_region WHERE r_end > r_start GROUP BY book_id, rclass_id, r_start, r_end)"
_WC = f"{_TK}, {_RG}, wc AS (SELECT r.book_id, r.rclass_id, r.r_start, r.r_end, r.rvalue, count(t.tok_start) AS word_count FROM (SELECT * FROM rg WHERE rclass_id IN (301, 501, 502, 503, 504)) r LEFT JOIN tk t ON t.book_id = r.book_id AND t.tok_start >= r.r_start AND t.tok_end <= r.r_end AND t.ttype IS NOT NULL GROUP BY r.book_id, r.rclass_id, r.r_start, r.r_end, r.rvalue)"
_TI = "ti AS (SELECT book_id, max(content) FILTER (rclass_id = 101) AS title, max(content) FILTER (rclass_id = 102) AS author FROM book_metadata WHERE rclass_id IN (101, 102) GROUP BY book_id)"
_LK = "lk AS (SELECT DISTINCT corpus_id, book_id FROM corpus_book)"


def _in(rclass: int, col: str = "part_of") -> str:
    return f"coalesce(list_contains(map_keys({col}), {rclass}), FALSE)"


def _val(rclass: int, col: str = "part_of") -> str:
    return f"coalesce(map_extract_value({col}, {rclass}), -1)"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def named(name: str, f: Query, sql: str | None) -> None:
    QUERIES[name] = f
    if sql is not None:
        SQL[name] = sql


def _tok(spark: SparkSession, d: str) -> DataFrame:
    return st.tokens(table(spark, d, "token"))


def _raw(spark: SparkSession, d: str) -> DataFrame:
    """The token table as it is, for operators that see to repeated rows themselves."""
    return table(spark, d, "token")


def _reg(spark: SparkSession, d: str) -> DataFrame:
    return st.regions(table(spark, d, "text_region"))


def _counts(spark: SparkSession, d: str) -> DataFrame:
    return st.word_counts(_raw(spark, d), _reg(spark, d), [301, 501, 502, 503, 504])


# ---- the store -------------------------------------------------------------------------------------------------


@query(f"WITH {_TK} SELECT book_id, tok_start, row_number() OVER (PARTITION BY book_id ORDER BY tok_start, tok_end)::INT AS ordering FROM tk")
def tokens_ordering(spark: SparkSession, d: str) -> DataFrame:
    return st.numbered(_tok(spark, d).drop("ordering")).select("book_id", "tok_start", "ordering")


@query(f"""
WITH {_TK}, {_RG}, h AS (SELECT t.book_id, t.tok_start, r.rclass_id, max(r.rvalue) AS v FROM tk t JOIN rg r ON r.book_id = t.book_id AND t.tok_start >= r.r_start AND t.tok_end <= r.r_end GROUP BY t.book_id, t.tok_start, r.rclass_id)
SELECT book_id, tok_start, string_agg(rclass_id || ':' || coalesce(v::VARCHAR, ''), ',' ORDER BY rclass_id) AS part_of FROM h GROUP BY book_id, tok_start""")
def region_containment_map(spark: SparkSession, d: str) -> DataFrame:
    t = st.with_part_of(_raw(spark, d).select("book_id", "tok_start", "tok_end"), _reg(spark, d)).where("part_of is not null")
    pairs = F.transform(F.array_sort(F.map_entries("part_of")), lambda e: F.concat(e["key"].cast("string"), F.lit(":"), F.coalesce(e["value"].cast("string"), F.lit(""))))
    return t.select("book_id", "tok_start", F.array_join(pairs, ",").alias("part_of"))


@query(f"WITH {_WC} SELECT book_id, rclass_id, r_start, r_end, rvalue, word_count FROM wc")
def region_word_counts(spark: SparkSession, d: str) -> DataFrame:
    return _counts(spark, d).select("book_id", "rclass_id", "r_start", "r_end", "rvalue", "word_count")


@query(f"WITH {_RG} SELECT r.book_id, r.rclass_id, r.rvalue, r.r_start, substring(b.content, r.r_start + 1, r.r_end - r.r_start) AS content FROM rg r JOIN book b ON b.book_id = r.book_id WHERE r.rclass_id IN (101, 102, 302, 303)")
def region_text(spark: SparkSession, d: str) -> DataFrame:
    return st.region_text(table(spark, d, "book"), _reg(spark, d), [101, 102, 302, 303])


@query(f"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{PORTABLE.replace("'", "''")}')) AS ttype, generate_subscripts(regexp_extract_all(lower(text), '{PORTABLE.replace("'", "''")}'), 1) AS position FROM documents)
SELECT doc_id, position::INT AS position, ttype FROM t""")
def portable_tokens(spark: SparkSession, d: str) -> DataFrame:
    from quireframe.functions.tokenise import portable_tokens as tokens

    return tokens(table(spark, d, "documents"), "doc_id", "text")


@query(f"""
WITH p AS (SELECT doc_id, regexp_extract_all(text, '{PORTABLE.replace("'", "''")}') AS tk, regexp_split_to_array(text, '{PORTABLE.replace("'", "''")}') AS gp FROM documents WHERE text IS NOT NULL),
t AS (SELECT doc_id, unnest(tk) AS tk, generate_subscripts(tk, 1) AS i, gp FROM p),
e AS (SELECT doc_id, i, tk, sum(length(gp[i]) + length(tk)) OVER (PARTITION BY doc_id ORDER BY i)::INT AS tok_end FROM t)
SELECT doc_id, i::INT AS position, tok_end - length(tk)::INT AS tok_start, tok_end, tk AS word FROM e""")
def token_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Portable tokens with their ranges, by prefix sums of what lies between."""
    from quireframe.functions.tokenise import portable_ranges

    return portable_ranges(table(spark, d, "documents"), "doc_id", "text")


@query(None)
def exact_tokens(spark: SparkSession, d: str) -> DataFrame:
    """The tokens of all whole books by the exact tokeniser."""
    from quireframe.functions.tokenise import token_table

    return token_table(table(spark, d, "book"))


@query(None)
def tagged_regions(spark: SparkSession, d: str) -> DataFrame:
    """The regions of all whole books by the taggers."""
    from quireframe.operators.tagging import tag_books

    return tag_books(table(spark, d, "book"))


# ---- word lists, clusters, key words ---------------------------------------------------------------------------


def _ngram_sql(n: int, rclass: int, having: str = "") -> str:
    return f"""
WITH {_TK}, f AS (SELECT * FROM tk WHERE {_in(rclass)}),
w AS (SELECT book_id, max(ordering) OVER w - min(ordering) OVER w = {n - 1} AND count(ttype) OVER w = {n} AS ok, string_agg(ttype, ' ') OVER w AS ngram
  FROM f WINDOW w AS (PARTITION BY book_id ORDER BY ordering ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)),
g AS (SELECT ngram, count(*) AS freq FROM w WHERE ok GROUP BY ngram)
SELECT ngram, freq FROM g {having}"""


def _cluster(n: int, subset: str, cutoff: int | None) -> Query:
    return lambda spark, d: cl.clusters(_raw(spark, d), SUBSETS[subset], n, cutoff)


named("wordlist_1gram", lambda spark, d: cl.word_list(_raw(spark, d), [301], 1), _ngram_sql(1, 301))
for _n, _least in ((2, 5), (3, 5), (4, 5), (5, 2), (6, 1), (7, 1)):  # long clusters hardly repeat
    named(f"cluster_{_n}gram", _cluster(_n, "all", _least), _ngram_sql(_n, 301, f"WHERE freq >= {_least}"))
named("cluster_quote_3gram", _cluster(3, "quote", None), _ngram_sql(3, 501, "WHERE freq >= 5"))
named("cluster_nonquote_2gram", _cluster(2, "nonquote", 2), _ngram_sql(2, 502, "WHERE freq >= 2"))
named("cluster_shortsus_2gram", _cluster(2, "shortsus", 1), _ngram_sql(2, 503))
named("cluster_longsus_3gram", _cluster(3, "longsus", 1), _ngram_sql(3, 504))
named("cluster_skipped_count", lambda spark, d: cl.skipped(_raw(spark, d), 301, 2, 5), f"SELECT count(*) AS skipped FROM ({_ngram_sql(2, 301)}) WHERE freq < 5")


@query(f"WITH {_TK}, b AS (SELECT min(book_id) AS b FROM book WHERE name LIKE 't%'), f AS (SELECT ttype FROM tk, b WHERE tk.book_id = b.b AND {_in(301)} AND ttype IS NOT NULL) SELECT ttype AS ngram, count(*) AS freq FROM f GROUP BY ttype HAVING count(*) >= 2")
def cluster_one_book(spark: SparkSession, d: str) -> DataFrame:
    """One book: the cutoff is 2."""
    first = table(spark, d, "book").where("name like 't%'").agg(F.min("book_id").alias("b"))
    return cl.clusters(_raw(spark, d).where(F.col("book_id") == first.scalar()), 301, 1, None, books=1)


def _keyword_sql(a: int, b: int, n: int, least: float | None, over: bool, digits: int = 4, tail: str = "") -> str:
    a_sql, b_sql = (_ngram_sql(n, x).replace("WITH ", "", 1).replace(_TK + ",", "") for x in (a, b))
    ren = lambda s, k: s.replace("f AS", f"f{k} AS").replace("FROM f ", f"FROM f{k} ").replace("w AS (SELECT book_id", f"w{k} AS (SELECT book_id").replace("FROM w WHERE", f"FROM w{k} WHERE").replace("g AS (SELECT ngram", f"g{k} AS (SELECT ngram").split("SELECT ngram, freq FROM g")[0].rstrip()
    return f"""
WITH {_TK},{ren(a_sql, 'a')},{ren(b_sql, 'b')},
t AS (SELECT (SELECT sum(freq) FROM ga)::BIGINT AS ta, (SELECT sum(freq) FROM gb)::BIGINT AS tb),
j AS (SELECT ga.ngram AS type, ga.freq AS a, coalesce(gb.freq, 0) AS b, ta, tb FROM ga LEFT JOIN gb ON ga.ngram = gb.ngram, t WHERE ga.freq >= 5),
e AS (SELECT *, ta * (a + b)::DOUBLE / (ta + tb) AS ea, tb * (a + b)::DOUBLE / (ta + tb) AS eb FROM j),
l AS (SELECT *, 2 * (a * ln(a / ea) + CASE WHEN b = 0 THEN 0.0 ELSE b * ln(b / eb) END) AS ll, CASE WHEN a > ea THEN '+' WHEN a < ea THEN '-' ELSE '0' END AS use FROM e)
SELECT type, a AS count_analysis, ta AS total_analysis, b AS count_ref, tb AS total_ref, round(ea, {digits}) AS expected_analysis, round(eb, {digits}) AS expected_ref, round(ll, {digits}) AS ll, use,
  CASE WHEN ll >= 15.13 THEN 0.0001 WHEN ll >= 10.83 THEN 0.001 WHEN ll >= 6.63 THEN 0.01 WHEN ll >= 3.84 THEN 0.05 END::DOUBLE AS p
FROM l WHERE {"use = '+'" if not over else "TRUE"} AND {f"ll >= {least}" if least else "TRUE"} {tail}"""


def _keyword(a: str, b: str, n: int, p: float, **kwargs) -> Query:
    return lambda spark, d: ke.keywords_within(_raw(spark, d), SUBSETS[a], SUBSETS[b], n, p, digits=4, half_even=False, **kwargs)


named("keyword_nonquote_vs_quote", _keyword("nonquote", "quote", 1, 0.0001), _keyword_sql(502, 501, 1, 15.13, False))
named("keyword_quote_vs_nonquote_2gram", _keyword("quote", "nonquote", 2, 0.01), _keyword_sql(501, 502, 2, 6.63, False))
named("keyword_underused_included", _keyword("quote", "all", 1, 0.05, exclude_underused=False), _keyword_sql(501, 301, 1, 3.84, True))
named("keyword_all_p", _keyword("longsus", "nonquote", 1, 1.0), _keyword_sql(504, 502, 1, None, False))
named("keyword_top3000", _keyword("nonquote", "quote", 1, 1.0, limit=3000), _keyword_sql(502, 501, 1, None, False, tail="ORDER BY a DESC, type LIMIT 3000"))


@query(f"""WITH {_TK}, g AS (SELECT ttype, count(*) AS n FROM tk WHERE {_in(501)} AND ttype IS NOT NULL GROUP BY ttype) SELECT ttype AS type, n AS count, round(n / (SELECT sum(n) FROM g)::DOUBLE * 100, 2) AS percentage FROM g""")
def facets_percentage(spark: SparkSession, d: str) -> DataFrame:
    from quireframe.api import facets

    return facets(cl.word_list(_raw(spark, d), [501]))


# ---- concordance ------------------------------------------------------------------------------------------------


def _conc_sql(patterns: list[str], rclass: int, context: int) -> str:
    """Windows over the whole table, the anchor's place aside: results are the same."""
    from quireframe.functions.tokenise import anchor

    k, i = len(patterns), anchor(patterns)
    lead = lambda c, j: c if j == 0 else f"lead({c}, {j}) OVER o" if j > 0 else f"lag({c}, {-j}) OVER o"
    cols = [f"{lead('ttype', j)} AS t{j}" for j in range(k)] + [f"{lead('inside', j)} AS i{j}" for j in range(k)]
    like = " AND ".join(f"""t{j} LIKE '{p.replace("'", "''")}' ESCAPE '\\' AND i{j}""" for j, p in enumerate(patterns))
    side = lambda js: "coalesce(array_to_string([" + ", ".join(f"x{'m' if j < 0 else ''}{abs(j)}" for j in js) + "], ' '), '')" if js else "''"
    extra = [f"{lead('ttype', j)} AS x{'m' if j < 0 else ''}{abs(j)}" for j in [*range(-context, 0), *range(k, k + context)]]
    return f"""
WITH {_TK}, s AS (SELECT *, {_in(rclass)} AS inside FROM tk),
w AS (SELECT book_id, ordering AS position, tok_start AS start, {lead('tok_end', k - 1)} AS "end", {', '.join(cols + extra)}, {lead(_val(301), i)} AS chapter, {lead(_val(401), i)} AS paragraph FROM s WINDOW o AS (PARTITION BY book_id ORDER BY ordering))
SELECT book_id, position, start, "end", {side(list(range(-context, 0)))} AS "left", array_to_string([{', '.join(f't{j}' for j in range(k))}], ' ') AS node, {side(list(range(k, k + context)))} AS "right", chapter, paragraph FROM w WHERE {like}"""


def _words(c: str):
    return F.array_join(F.transform(c, lambda t: t["ttype"]), " ").alias(c)


def _conc(q: str, subset: str, context: int) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return cc.concordance(_raw(spark, d), [q], [SUBSETS[subset]], context).select("book_id", "position", "start", "end", _words("left"), _words("node"), _words("right"), "chapter", "paragraph")

    return run


for _name, _q, _s, _c in (
    ("conc_single", "window", "all", 0), ("conc_phrase2", "of the", "all", 0), ("conc_phrase3", "on the *", "all", 2), ("conc_wildcard_star", "con*", "all", 0), ("conc_wildcard_qmark", "wh?n", "all", 0),
    ("conc_straddle", "* said *", "all", 1), ("conc_context3", "concordance", "all", 3), ("conc_quote_subset", "the *", "quote", 2), ("conc_nonquote_subset", "said *", "nonquote", 5), ("conc_longsus", "replied *", "longsus", 1),
):
    named(_name, _conc(_q, _s, _c), _conc_sql(parse_query(_q), SUBSETS[_s], _c))


@query(f"SELECT q, lines FROM (SELECT 'th?' AS q, count(*) AS lines FROM ({_conc_sql(['th_'], 301, 0)}) UNION ALL SELECT 'th_', count(*) FROM ({_conc_sql([chr(116) + chr(104) + chr(92) + '_'], 301, 0)}))")
def conc_escape_underscore(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a word with a wildcard, and of one with an underscore of its own, which is none."""
    lines = lambda q: cc.concordance(_raw(spark, d), [q], [301]).agg(F.count(F.lit(1)).alias("lines")).select(F.lit(q).alias("q"), "lines")
    return lines("th?").unionByName(lines("th_"))


@query(f"SELECT book_id, count(*) AS lines FROM ({' UNION ALL '.join('SELECT book_id, position FROM (' + _conc_sql(parse_query(q), 301, 0) + ')' for q in ('window', 'lantern', 'kettle'))}) GROUP BY book_id")
def conc_any_word(spark: SparkSession, d: str) -> DataFrame:
    """Several words, each a query of its own: a bag union."""
    from quireframe.functions.tokenise import any_words

    return cc.concordance(_raw(spark, d), any_words("window ! lantern kettle"), [301]).groupBy("book_id").agg(F.count(F.lit(1)).alias("lines"))


@query(None)
def conc_texts(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a frequent word with the text of their windows, cut from whole books."""
    lines = cc.with_text(cc.concordance(_raw(spark, d), ["window"], [301], 5), table(spark, d, "book"))
    return lines.select("book_id", "position", "start", "end", "left", "node", "right")


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a frequent word with context words as arrays and a match count."""
    rows = cc.concordance(_raw(spark, d), ["window"], [301], 5)
    words = lambda c: F.transform(c, lambda t: t["ttype"]).alias(c)
    rows = rows.select("book_id", "start", "end", words("left"), words("node"), words("right"))
    return rows.withColumn("kwic", kw.score(F.col("left"), F.col("right"), ["The", "of", "a"], "-3:2"))


_LINES = f"""
WITH {_TK}, w AS (SELECT book_id, tok_start AS start, tok_end AS "end", ttype, {_in(301)} AS inside,
  [lag(ttype, 5) OVER o, lag(ttype, 4) OVER o, lag(ttype, 3) OVER o, lag(ttype, 2) OVER o, lag(ttype, 1) OVER o] AS l, [lead(ttype, 1) OVER o, lead(ttype, 2) OVER o, lead(ttype, 3) OVER o, lead(ttype, 4) OVER o, lead(ttype, 5) OVER o] AS r
  FROM tk WINDOW o AS (PARTITION BY book_id ORDER BY ordering)),
v AS (SELECT *, len(list_intersect(list_distinct(l[3:5] || r[1:2]), ['the', 'of', 'a'])) AS kwic FROM w WHERE ttype = 'window' AND inside)"""


@query(_LINES + ' SELECT book_id, start, "end", kwic::INT AS kwic FROM v')
def kwic_score(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).select("book_id", "start", "end", "kwic")


@query(_LINES + " SELECT kwic::INT AS kwic, count(*) AS lines, count(DISTINCT book_id) AS books FROM v GROUP BY kwic")
def kwic_summary(spark: SparkSession, d: str) -> DataFrame:
    return kw.summary(_lines(spark, d))


@query(_LINES + " SELECT book_id, start, " + " || ".join(f"coalesce({x} || ':', '')" for x in ("l[5]", "l[4]", "l[3]")) + " AS left_key, " + " || ".join(f"coalesce({x} || ':', '')" for x in ("r[1]", "r[2]", "r[3]")) + " AS right_key FROM v")
def context_sort_keys(spark: SparkSession, d: str) -> DataFrame:
    """Of every line, those with little context too: what is not there adds nothing to a key."""
    return _lines(spark, d).select("book_id", "start", kw.sort_key(F.col("left"), left=True).alias("left_key"), kw.sort_key(F.col("right")).alias("right_key"))


@query(_LINES + f""", n AS (SELECT book_id, count(*) AS words FROM tk WHERE ttype IS NOT NULL AND {_in(301)} GROUP BY book_id),
g AS (SELECT book_id, count(*) AS lines, max(kwic)::INT AS max_kwic, count(*) FILTER (kwic > 0) AS kwic_count FROM v GROUP BY book_id)
SELECT g.book_id, lines, max_kwic, kwic_count, round(lines / words::DOUBLE * 1000000, 2) AS rel_freq FROM g JOIN n USING (book_id)""")
def dist_plot_rows(spark: SparkSession, d: str) -> DataFrame:
    words = su.counts(_raw(spark, d).where("ttype is not null"), {"words": 301})
    return kw.by_book(_lines(spark, d)).join(words, "book_id").withColumn("rel_freq", kw.per_million(F.col("lines"), F.col("words"))).drop("words")


@query(_LINES + """ SELECT book_id, start FROM v WHERE lower(array_to_string(list_filter(l, lambda x: x IS NOT NULL), ' ') || ' window ' || array_to_string(list_filter(r, lambda x: x IS NOT NULL), ' ')) LIKE '%e of%'""")
def row_filter_contains(spark: SparkSession, d: str) -> DataFrame:
    rows = _lines(spark, d).select("book_id", "start", *(F.array_join(c, " ").alias(c) for c in ("left", "node", "right")))
    return kw.row_filter(rows, ["left", "node", "right"], "E OF").select("book_id", "start")


@query(_LINES + """ SELECT DISTINCT unnest(l[3:5] || r[1:2]) AS ttype FROM v""")
def context_all_words(spark: SparkSession, d: str) -> DataFrame:
    return kw.all_words(_lines(spark, d), "left", "right", "-3:2").where("ttype is not null")


SQL["context_all_words"] = _LINES + " SELECT ttype FROM (SELECT DISTINCT unnest(l[3:5] || r[1:2]) AS ttype FROM v) WHERE ttype IS NOT NULL"


@query(_LINES + """ SELECT book_id || ':' || start || ':' || "end" AS row_id, (start / e.n::DOUBLE) AS position FROM v JOIN (SELECT book_id AS b, max(r_end) AS n FROM text_region WHERE rclass_id = 301 AND r_end > r_start GROUP BY book_id) e ON e.b = v.book_id ORDER BY v.book_id, start LIMIT 50""")
def result_page(spark: SparkSession, d: str) -> DataFrame:
    """The first page of lines by place, with row ids and relative positions. The limit is the feature."""
    end = fo.chapter_starts(_reg(spark, d)).where("chapter = '_end'").select("book_id", F.col("start").alias("n"))
    rows = _lines(spark, d).join(end, "book_id")
    first = kw.page(rows, [F.col("book_id"), F.col("start")], 0)
    return first.select(kw.row_id("book_id").alias("row_id"), kw.relative_position(F.col("start"), F.col("n")).alias("position"))


# ---- subsets, counts, footers -------------------------------------------------------------------------------------


@query(f"""
WITH {_TK}, {_RG}, q AS (SELECT * FROM rg WHERE rclass_id IN (503, 504)),
m AS (SELECT r.book_id, r.rclass_id, r.r_start, r.r_end, t.tok_start, t.tok_end, t.ttype, t.part_of, CASE WHEN t.tok_start < r.r_start THEN 0 WHEN t.tok_end <= r.r_end THEN 1 ELSE 2 END AS side
  FROM q r JOIN tk t ON t.book_id = r.book_id AND t.tok_start >= r.r_start - 50 AND t.tok_end <= r.r_end + 50)
SELECT book_id, rclass_id, r_start AS start, r_end AS "end", coalesce(string_agg(ttype, ' ' ORDER BY tok_start) FILTER (side = 0), '') AS "left", coalesce(string_agg(ttype, ' ' ORDER BY tok_start) FILTER (side = 1), '') AS node,
  coalesce(string_agg(ttype, ' ' ORDER BY tok_start) FILTER (side = 2), '') AS "right", first({_val(301)} ORDER BY tok_start) AS chapter, first({_val(401)} ORDER BY tok_start) AS paragraph
FROM m GROUP BY book_id, rclass_id, r_start, r_end HAVING count(*) FILTER (side = 1) > 0""")
def region_expand_subset(spark: SparkSession, d: str) -> DataFrame:
    rows = su.listing(_raw(spark, d), _reg(spark, d), [503, 504], 5)
    return rows.select("book_id", "rclass_id", "start", "end", _words("left"), _words("node"), _words("right"), "chapter", "paragraph")


@query(f"WITH {_TK} SELECT book_id, " + ", ".join(f'count(*) FILTER ({_in(c)}) AS "{n}"' for n, c in SUBSETS.items()) + " FROM tk GROUP BY book_id")
def count_by_subset(spark: SparkSession, d: str) -> DataFrame:
    return su.counts(_raw(spark, d), SUBSETS)


@query(f"WITH {_TK}, {_RG} SELECT count(DISTINCT book_id) AS books, " + ", ".join(f'sum("{n}")::BIGINT AS "{n}"' for n in SUBSETS) + f", (SELECT count(*) FROM (SELECT DISTINCT book_id, rvalue FROM rg WHERE rclass_id = 302)) AS chapters FROM (SELECT book_id, " + ", ".join(f'count(*) FILTER ({_in(c)}) AS "{n}"' for n, c in SUBSETS.items()) + " FROM tk GROUP BY book_id)")
def count_totals(spark: SparkSession, d: str) -> DataFrame:
    chapters = _reg(spark, d).where("rclass_id = 302").select("book_id", "rvalue").distinct().agg(F.count(F.lit(1)).alias("chapters"))
    rows = su.counts(_raw(spark, d), SUBSETS).agg(F.count(F.lit(1)).alias("books"), *(F.sum(n).alias(n) for n in SUBSETS))
    return rows.withColumn("chapters", chapters.scalar())


@query(f"WITH {_RG} SELECT book_id, rvalue::VARCHAR AS chapter, min(r_start) AS start FROM rg WHERE rclass_id = 301 GROUP BY book_id, rvalue UNION ALL SELECT book_id, '_end', max(r_end) FROM rg WHERE rclass_id = 301 GROUP BY book_id")
def chapter_start(spark: SparkSession, d: str) -> DataFrame:
    return fo.chapter_starts(_reg(spark, d))


@query(f"""WITH {_WC}, c AS (SELECT book_id, rvalue, sum(word_count)::BIGINT AS n FROM wc WHERE rclass_id = 301 GROUP BY book_id, rvalue)
SELECT book_id, rvalue::VARCHAR AS chapter, coalesce(sum(n) OVER (PARTITION BY book_id ORDER BY rvalue NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS words FROM c UNION ALL SELECT book_id, '_end', sum(n)::BIGINT FROM c GROUP BY book_id""")
def word_count_before_chapter(spark: SparkSession, d: str) -> DataFrame:
    return fo.words_before(_counts(spark, d))


@query(f"WITH {_WC} SELECT book_id, sum(word_count)::BIGINT AS words FROM wc WHERE rclass_id = 501 GROUP BY book_id")
def word_count_subset(spark: SparkSession, d: str) -> DataFrame:
    return fo.words_in(_counts(spark, d), 501)


@query(f"WITH {_WC}, a AS (SELECT book_id, sum(word_count)::BIGINT AS words FROM wc WHERE rclass_id = 301 GROUP BY book_id), q AS (SELECT book_id, sum(word_count)::BIGINT AS n FROM wc WHERE rclass_id = 501 GROUP BY book_id) SELECT book_id, round(n / words::DOUBLE * 100, 2) AS share FROM a JOIN q USING (book_id) WHERE words > 0")
def subset_share_pct(spark: SparkSession, d: str) -> DataFrame:
    counts = _counts(spark, d)
    rows = fo.words_in(counts, 301).join(fo.words_in(counts, 501).withColumnRenamed("words", "n"), "book_id").where("words > 0")
    return rows.select("book_id", kw.share(F.col("n"), F.col("words")).alias("share"))


@query(f"WITH {_TI} SELECT book_id, title, author FROM ti")
def book_titles_pivot(spark: SparkSession, d: str) -> DataFrame:
    return co.titles(table(spark, d, "book_metadata"))


@query(f"WITH {_RG} SELECT book_id, rclass_id, r_start, r_end, rvalue FROM rg JOIN (SELECT min(book_id) AS b FROM book WHERE content <> '') ON b = book_id WHERE rclass_id IN (301, 401)")
def text_with_regions(spark: SparkSession, d: str) -> DataFrame:
    """The regions of one book, as they go with its text."""
    one = table(spark, d, "book").where("content <> ''").agg(F.min("book_id").alias("b")).scalar()
    return _reg(spark, d).where((F.col("book_id") == one) & F.col("rclass_id").isin(301, 401))


# ---- corpora ------------------------------------------------------------------------------------------------------

_LIST = f"{_TI}, {_LK}, ls AS (SELECT c.name AS corpus_name, c.title AS corpus_title, c.ordering, b.book_id, b.name AS book_name, ti.title, ti.author FROM lk JOIN corpus c USING (corpus_id) JOIN ti USING (book_id) JOIN book b USING (book_id))"


def _listing(spark: SparkSession, d: str) -> DataFrame:
    return co.listing(*(table(spark, d, t) for t in ("corpus", "corpus_book", "book", "book_metadata")))


@query(f"WITH {_LIST} SELECT corpus_name, corpus_title, ordering, book_id, book_name, title, author FROM ls")
def corpora_listing(spark: SparkSession, d: str) -> DataFrame:
    return _listing(spark, d)


@query(f"WITH {_LIST} SELECT corpus_name, ordering, string_agg(book_name || '=' || coalesce(title, ''), '|' ORDER BY book_name) AS children FROM ls GROUP BY corpus_name, ordering")
def corpora_nested(spark: SparkSession, d: str) -> DataFrame:
    rows = co.nested_listing(_listing(spark, d))
    return rows.select("corpus_name", "ordering", F.array_join(F.transform("children", lambda c: F.concat(c["id"], F.lit("="), F.coalesce(c["title"], F.lit("")))), "|").alias("children"))


@query(f"WITH {_LIST} SELECT author, count(*) AS books FROM ls GROUP BY author")
def books_per_author(spark: SparkSession, d: str) -> DataFrame:
    return co.books_per_author(_listing(spark, d))


@query(f"WITH {_WC}, {_LK}, n AS (SELECT book_id, sum(word_count)::BIGINT AS n FROM wc WHERE rclass_id = 301 GROUP BY book_id) SELECT c.name, c.title, c.ordering, count(*) AS book_count, coalesce(sum(n), 0)::BIGINT AS word_count FROM corpus c JOIN lk USING (corpus_id) LEFT JOIN n USING (book_id) GROUP BY c.name, c.title, c.ordering")
def headlines(spark: SparkSession, d: str) -> DataFrame:
    return co.headlines(table(spark, d, "corpus"), table(spark, d, "corpus_book"), _counts(spark, d))


@query("SELECT octet_length(carousel_image)::INT AS bytes, md5(carousel_image) AS md5 FROM corpus WHERE name = 'serials'")
def corpora_image(spark: SparkSession, d: str) -> DataFrame:
    return co.image(table(spark, d, "corpus"), "corpus:serials").select(F.octet_length("image").alias("bytes"), F.md5("image").alias("md5"))


@query("WITH s AS (SELECT book_id FROM corpus_book JOIN corpus USING (corpus_id) WHERE name IN ('sea', 'eastern') UNION SELECT book_id FROM book_metadata WHERE rclass_id = 102 AND content = 'Driwellri Nowhufaibifloond' UNION SELECT book_id FROM book WHERE book_id IN (3, 5)) SELECT DISTINCT book_id FROM s")
def resolve_corpus_alias(spark: SparkSession, d: str) -> DataFrame:
    return co.resolve(["old", "author:Driwellri Nowhufaibifloond", 3, 5], *(table(spark, d, t) for t in ("corpus", "corpus_book", "book", "book_metadata")), aliases={"old": ["corpus:sea", "older"], "older": ["corpus:eastern"]})


@query("SELECT c.corpus_id FROM corpus c WHERE c.corpus_id IN (SELECT corpus_id FROM corpus_book WHERE book_id IN (SELECT book_id FROM book_metadata WHERE rclass_id = 106 AND lower(trim(content)) = 'yes'))")
def corpora_touching_books(spark: SparkSession, d: str) -> DataFrame:
    """Corpora that have one of some given books, those that are said to have plates: a semi join."""
    some = table(spark, d, "book_metadata").where("rclass_id = 106 and lower(trim(content)) = 'yes'").select("book_id")
    touched = table(spark, d, "corpus_book").join(some, "book_id", "left_semi")
    return table(spark, d, "corpus").join(touched, "corpus_id", "left_semi").select("corpus_id")


@query("SELECT corpus_id FROM corpus WHERE corpus_id IN (SELECT l.corpus_id FROM corpus_book l JOIN book b ON b.book_id = l.book_id WHERE b.content <> '')")
def corpora_with_texts(spark: SparkSession, d: str) -> DataFrame:
    """Corpora that have a book with a text: links of all books are looked at."""
    some = table(spark, d, "book").where("content <> ''").select("book_id")
    touched = table(spark, d, "corpus_book").join(some, "book_id", "left_semi").select("corpus_id").distinct()
    return table(spark, d, "corpus").join(touched, "corpus_id", "left_semi").select("corpus_id")


@query(f"WITH {_TK}, y AS (SELECT DISTINCT ttype FROM tk WHERE ttype LIKE 'con%') SELECT ttype, count(*) AS freq FROM tk WHERE ttype IN (SELECT ttype FROM y) GROUP BY ttype")
def like_on_types_semi(spark: SparkSession, d: str) -> DataFrame:
    """A pattern held against distinct types first, then a semi join."""
    tok = _tok(spark, d)
    types = tok.select("ttype").distinct().where(F.col("ttype").like("con%"))
    return tok.join(types, "ttype", "left_semi").groupBy("ttype").agg(F.count(F.lit(1)).alias("freq"))


# ---- intervals ----------------------------------------------------------------------------------------------------


@query(f"WITH {_RG}, l AS (SELECT book_id, length(content)::INT AS n FROM book WHERE content IS NOT NULL), x AS (SELECT book_id, r_start, r_end FROM rg WHERE rclass_id IN (101, 102, 302) AND book_id IN (SELECT book_id FROM l) UNION ALL SELECT book_id, n, n FROM l), g AS (SELECT book_id, coalesce(max(r_end) OVER (PARTITION BY book_id ORDER BY r_start, r_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a, r_start AS z FROM x) SELECT book_id, a AS r_start, z AS r_end FROM g WHERE a < z")
def region_invert(spark: SparkSession, d: str) -> DataFrame:
    lengths = table(spark, d, "book").where("content is not null").select("book_id", F.length("content").alias("length"))
    heads = _reg(spark, d).where(F.col("rclass_id").isin(101, 102, 302)).join(lengths.select("book_id"), "book_id", "left_semi")
    return iv.complement(heads, ["book_id"], lengths)


@query(f"WITH {_RG}, g AS (SELECT book_id, max(r_end) OVER (PARTITION BY book_id ORDER BY r_start, r_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a, r_start AS z FROM rg WHERE rclass_id = 302) SELECT book_id, a AS r_start, z AS r_end FROM g WHERE a < z")
def region_invert_inner(spark: SparkSession, d: str) -> DataFrame:
    return iv.complement(_reg(spark, d).where("rclass_id = 302"), ["book_id"])


@query(f"WITH {_RG} SELECT book_id, rclass_id, min(r_start) AS r_start, max(r_end) AS r_end FROM rg GROUP BY book_id, rclass_id")
def range_merge(spark: SparkSession, d: str) -> DataFrame:
    return iv.span(_reg(spark, d), ["book_id", "rclass_id"])


@query(f"""WITH {_RG}, q AS (SELECT * FROM rg WHERE rclass_id BETWEEN 501 AND 505), c AS (SELECT book_id, r_start AS p FROM q UNION SELECT book_id, r_end FROM q),
s AS (SELECT book_id, p AS a, lead(p) OVER (PARTITION BY book_id ORDER BY p) AS z FROM c)
SELECT s.book_id, a AS r_start, z AS r_end, string_agg(DISTINCT q.rclass_id::VARCHAR, ',' ORDER BY q.rclass_id::VARCHAR) AS labels FROM s JOIN q ON q.book_id = s.book_id AND q.r_start <= s.a AND s.z <= q.r_end WHERE z IS NOT NULL GROUP BY s.book_id, a, z""")
def region_segments(spark: SparkSession, d: str) -> DataFrame:
    rows = iv.segments(_reg(spark, d).where("rclass_id between 501 and 505"), "book_id", "rclass_id")
    return rows.withColumn("labels", F.array_join("labels", ","))


@query(f"WITH {_RG} SELECT book_id, rclass_id, r_start, r_end, CASE WHEN length(c) >= 40 THEN replace(left(c, 20) || '...' || right(c, 20), chr(10), ' ') ELSE replace(c, chr(10), ' ') END AS preview FROM (SELECT r.*, substring(b.content, r.r_start + 1, r.r_end - r.r_start) AS c FROM rg r JOIN book b USING (book_id) WHERE b.content IS NOT NULL AND r.rclass_id IN (302, 503))")
def region_preview(spark: SparkSession, d: str) -> DataFrame:
    from quireframe.sources.export import preview

    rows = _reg(spark, d).where(F.col("rclass_id").isin(302, 503)).join(table(spark, d, "book").where("content is not null").select("book_id", "content"), "book_id")
    return rows.select("book_id", "rclass_id", "r_start", "r_end", preview(F.substring("content", F.col("r_start") + 1, F.col("r_end") - F.col("r_start"))).alias("preview"))


@query(None)
def region_previews(spark: SparkSession, d: str) -> DataFrame:
    """The preview of every region, as side-cars have it, long ranges too."""
    from quireframe.sources.export import region_rows

    names = {r["rclass_id"]: r["name"] for r in table(spark, d, "rclass").collect()}
    return region_rows(_reg(spark, d), table(spark, d, "book"), names)


@query(f"WITH {_RG}, x AS (SELECT r.*, substring(b.content, r.r_start + 1, r.r_end - r.r_start) AS c FROM rg r JOIN book b USING (book_id) WHERE rclass_id IN (302, 303)), p AS (SELECT *, last_value(CASE WHEN rclass_id = 303 THEN c END IGNORE NULLS) OVER (PARTITION BY book_id ORDER BY r_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS part FROM x) SELECT book_id, r_start, concat_ws(' ', part, c) AS heading FROM p WHERE rclass_id = 302")
def chapter_headings(spark: SparkSession, d: str) -> DataFrame:
    return kw.headings_with_part(st.region_text(table(spark, d, "book"), _reg(spark, d), [302, 303]))


@query(f"WITH {_RG}, x AS (SELECT r.book_id, r.rclass_id, r.r_start - 3 AS a, r.r_end + 3 AS z, b.content FROM rg r JOIN book b USING (book_id) WHERE b.content IS NOT NULL AND rclass_id = 302 AND r.r_start >= 3), c AS (SELECT *, substring(content, a + 1, z - a) AS t FROM x) SELECT book_id, (a + length(t) - length(regexp_replace(t, '^[\\s\\p{{Z}}]+', '')))::INT AS r_start, (z - length(t) + length(regexp_replace(t, '[\\s\\p{{Z}}]+$', '')))::INT AS r_end FROM c WHERE trim(t) <> ''")
def region_trimmed(spark: SparkSession, d: str) -> DataFrame:
    """Headings with three characters more on either side, without the white space that brings."""
    rows = _reg(spark, d).where("rclass_id = 302 and r_start >= 3").join(table(spark, d, "book").where("content is not null").select("book_id", "content"), "book_id")
    wide = iv.expanded(F.col("r_start"), F.col("r_end"), 3)
    return iv.trimmed(rows.withColumns({"r_start": wide[0], "r_end": wide[1]}), "content").select("book_id", "r_start", "r_end")


# ---- tags -----------------------------------------------------------------------------------------------------------


def _tags(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two sets of tags made from links of books to corpora."""
    rows = co.links(table(spark, d, "corpus_book")).select(F.col("corpus_id").cast("string").alias("tag"), F.col("book_id").cast("string").alias("row_id"))
    return rows.where("tag in ('2', '3')"), rows.where("tag in ('3', '4')")


@query(f"WITH {_LK} SELECT CASE WHEN s = 1 THEN corpus_id::VARCHAR WHEN corpus_id = 3 THEN 'n3-1' ELSE 'n4' END AS tag, count(*) AS n FROM (SELECT 1 AS s, * FROM lk WHERE corpus_id IN (2, 3) UNION ALL SELECT 2, * FROM lk WHERE corpus_id IN (3, 4)) GROUP BY 1")
def tag_merge(spark: SparkSession, d: str) -> DataFrame:
    own, other = _tags(spark, d)
    merged, _ = tg.merge(own, other, ["2", "3", "n3"], ["3", "4"])
    return merged.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_LK}, s AS (SELECT DISTINCT book_id FROM lk WHERE corpus_id = 3), h AS (SELECT t.tag, bool_and(l.book_id IS NOT NULL) AS a, bool_or(l.book_id IS NOT NULL) AS b FROM (VALUES (2), (3), (99)) t(tag) CROSS JOIN s LEFT JOIN lk l ON l.corpus_id = t.tag AND l.book_id = s.book_id AND l.corpus_id IN (2, 3) GROUP BY t.tag) SELECT tag::VARCHAR AS tag, CASE WHEN a THEN 'yes' WHEN NOT b THEN 'no' ELSE 'mix' END AS state FROM h")
def tag_state_yes_no_mix(spark: SparkSession, d: str) -> DataFrame:
    own, other = _tags(spark, d)
    return tg.states(own, other.where("tag = '3'").select("row_id"), ["2", "3", "99"])


@query(f"WITH {_LK}, i AS (SELECT DISTINCT book_id FROM lk WHERE corpus_id IN (2, 3)) SELECT book_id::VARCHAR AS row_id, bool_or(corpus_id = 2) AS two, bool_or(corpus_id = 3) AS three FROM lk WHERE corpus_id IN (2, 3) GROUP BY book_id")
def tag_columns(spark: SparkSession, d: str) -> DataFrame:
    own, _ = _tags(spark, d)
    return tg.add_columns(own.select("row_id").distinct(), own, ["2", "3"]).select("row_id", F.col("`tag:2`").alias("two"), F.col("`tag:3`").alias("three"))


@query(f"WITH {_TK} SELECT ttype, count(*) AS freq FROM tk WHERE ttype IS NOT NULL GROUP BY ttype ORDER BY freq DESC, ttype LIMIT 100")
def topk_sorted(spark: SparkSession, d: str) -> DataFrame:
    """The hundred most frequent types. The limit is the feature."""
    return _tok(spark, d).where("ttype is not null").groupBy("ttype").agg(F.count(F.lit(1)).alias("freq")).orderBy(F.desc("freq"), "ttype").limit(100)

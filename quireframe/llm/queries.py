"""The queries of the training-text problems and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireframe.llm import frequency, heavy, leaks, packing, plain, residue, sentences
from quireframe.session import cut, table

Query = Callable[[SparkSession, str], DataFrame]

SHARE = 0.0025


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.sentences(table(spark, sf_dir, "book"), "book_id", "content").select("book_id", "s_start", "s_end")


def p2_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters and digits in the sentences of each book: all that its paragraphs have, none twice."""
    rows = sentences.sentences(table(spark, sf_dir, "book"), "book_id", "content")
    return rows.groupBy("book_id").agg(F.sum(F.length(F.regexp_replace("sentence", "[^\\p{L}\\p{N}]+", ""))).alias("letters")).where("letters > 0")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heavy.heavy_hitters(table(spark, sf_dir, "token"), "ttype", SHARE).select("ttype")


def p3_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heavy types with exact counts."""
    return heavy.heavy_hitters(table(spark, sf_dir, "token"), "ttype", SHARE).select("ttype", "n")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain.plain_tokens(table(spark, sf_dir, "token"), table(spark, sf_dir, "book"), "ttype", "book_id", "tok_start", "content")


def p5_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every book that has a content: the content in plain form, with its length before and after."""
    book = table(spark, sf_dir, "book").where("content is not null").select("book_id", "content", F.length("content").alias("n_before"))
    return plain.canonical_texts(book, "content").select("book_id", "n_before", F.length("content").alias("n_after"), "content")


def _frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    token = table(spark, sf_dir, "token")
    books = token.agg(F.count_distinct("book_id").alias("books"))
    return frequency.mark_extremes(frequency.value_frequencies(token, "ttype", "book_id", "tok_start"), books)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frequencies(spark, sf_dir).where("mark is not null").select("ttype", "mark")


def p6_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct type with its occurrences and books, marked."""
    return _frequencies(spark, sf_dir).select("ttype", F.col("occurrences"), F.col("records").alias("books"), F.coalesce("mark", F.lit("kept")).alias("mark"))


#: Tokens a container holds.
CONTAINER = 4096


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").alias("n_tokens"))
    return packing.pack(sizes, "doc_id", "n_tokens", CONTAINER)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir).where("piece = 1").select("doc_id").distinct()


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers of all documents are: containers, those that need be at least, and tokens."""
    per = _packed(spark, sf_dir).groupBy("container").agg(F.sum("size").alias("n"))
    return per.agg(F.count(F.lit(1)).alias("containers"), F.ceil(F.sum("n") / CONTAINER).alias("at_least"), F.sum("n").alias("tokens"), F.max("n").alias("fullest"))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of a packing, whatever it looks like: every token once, no container overfull, none split that
    fits, and at most a hundredth and one more containers than any packing needs."""
    rows = cut(_packed(spark, sf_dir))
    bins = rows.groupBy("container").agg(F.sum("size").alias("n")).agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("tokens"), F.count_if(F.col("n") > CONTAINER).alias("overfull"), F.ceil(F.sum("n") / CONTAINER).alias("at_least"))
    docs = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k"), F.sum("size").alias("n")).agg(F.count(F.lit(1)).alias("documents"), F.sum("k").alias("pieces"), F.count_if(F.col("k") != F.greatest(F.ceil(F.col("n") / CONTAINER), F.lit(1))).alias("split_in_vain"))
    one = F.lit(1).alias("one")  # a row each
    return bins.select("*", one).join(docs.select("*", one), "one").select("tokens", "at_least", "overfull", "documents", "pieces", "split_in_vain", (F.col("c") <= F.col("at_least") * 1.01 + 1).alias("tight"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "heldout_item"), "doc_id", "text", "item_id", "text")


def p8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the items of which they hold a passage, unbroken or edited: least edits, longest run seen."""
    return leaks.passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "heldout_item"), "doc_id", "text", "item_id", "text")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue(table(spark, sf_dir, "documents"), "doc_id", "text", host="source").select("doc_id")


QUERIES: dict[str, Query] = {f.__name__: f for f in (p2_found, p2_letters, p3_found, p3_counts, p5_found, p5_contents, p6_found, p6_frequencies, p7_found, p7_fill, p7_containers, p8_found, p8_passages, p9_found)}

_P3 = f"""
WITH c AS (SELECT ttype, count(*) AS n FROM token WHERE ttype IS NOT NULL GROUP BY ttype)
SELECT ttype%s FROM c WHERE n >= {SHARE} * (SELECT sum(n) FROM c)
"""
_P6 = """
WITH t AS (SELECT DISTINCT book_id, tok_start, ttype FROM token WHERE ttype IS NOT NULL),
c AS (SELECT ttype, count(*) AS occurrences, count(DISTINCT book_id) AS books FROM t GROUP BY ttype),
b AS (SELECT count(DISTINCT book_id) AS n FROM token),
m AS (SELECT ttype, occurrences, books,
  CASE WHEN occurrences < 3 THEN 'rare' WHEN books > 0.5 * n THEN 'common' ELSE 'kept' END AS mark FROM c, b)
SELECT %s FROM m
"""
_WIDE = "".join(chr(0xFF01 + i) for i in range(94)), "".join(chr(0x21 + i) for i in range(94)).replace("'", "''")
_KANA = "ｦｧｨｩｪｫｬｭｮｯｰｱｲｳｴｵｶｷｸｹｺｻｼｽｾｿﾀﾁﾂﾃﾄﾅﾆﾇﾈﾉﾊﾋﾌﾍﾎﾏﾐﾑﾒﾓﾔﾕﾖﾗﾘﾙﾚﾛﾜﾝ", "ヲァィゥェォャュョッーアイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワン"


# The SQL has tables of its own, so that a wrong one in the operator shows.
_TO = {
    "latin": (("асеорухіјѕАВСЕНІЈКМОРЅТХУονΑΒΕΖΗΙΚΜΝΟΡΤΥΧօ", "aceopyxijsABCEHIJKMOPSTXYovABEZHIKMNOPTYXo"), ("һԛԝӏαικρυχγսոհցզյ", "hqwlaikpuxyunhgqj")),
    "cyrillic": (("aceopyxijsABCEHIJKMOPSTXY", "асеорухіјѕАВСЕНІЈКМОРЅТХУ"), ("hqwl", "һԛԝӏ")),
    "greek": (("ovABEZHIKMNOPTYX", "ονΑΒΕΖΗΙΚΜΝΟΡΤΥΧ"), ("aikpuxy", "αικρυχγ")),
    "armenian": (("o", "օ"), ("unhgqj", "սոհցզյ")),
}
_SCRIPT = {"latin": "\\p{Latin}", "cyrillic": "\\p{Cyrillic}", "greek": "\\p{Greek}", "armenian": "\\p{Armenian}"}
_QUOTES, _DASHES = "‘’‛ʼʻʹˈ′´`＇Ꞌꞌ", "‐‑‒−﹣－⁃֊"


def _clean_sql(script: str) -> str:
    (a, b), (x, y) = _TO[script]
    return f"CASE WHEN regexp_matches(x, '{_SCRIPT[script]}') THEN nfc_normalize(translate(x, '{a}{x}', '{b}{y}')) WHEN regexp_full_match(x, '[{a}\\P{{L}}]+') THEN translate(x, '{a}', '{b}') ELSE x END"


def _p5_sql() -> str:
    count = {n: f"length(regexp_replace(content, '[^{c}]+', '', 'g'))" for n, c in _SCRIPT.items()}
    ligatures = "x0"
    for one, many in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st")):
        ligatures = f"replace({ligatures}, '{one}', '{many}')"
    return f"""
WITH r AS (SELECT book_id, content, length(regexp_replace(content, '[^\\p{{L}}]+', '', 'g')) AS letters, {', '.join(f'{c} AS {n}' for n, c in count.items())} FROM book),
b AS (SELECT book_id, CASE WHEN content IS NULL THEN NULL WHEN latin * 2 >= letters THEN 'latin' {' '.join(f"WHEN {n} * 2 > letters - latin THEN '{n}'" for n in ("cyrillic", "greek", "armenian"))} ELSE 'other' END AS script FROM r),
t AS (SELECT DISTINCT book_id, tok_start, ttype FROM token WHERE ttype IS NOT NULL),
u AS (SELECT *, translate(translate(translate(regexp_replace(ttype, '[\\p{{Cf}}\\p{{Z}}\\p{{Cc}}]+', '', 'g'), '{_QUOTES}{_DASHES}', '{"''" * len(_QUOTES)}{'-' * len(_DASHES)}'), '{_WIDE[0]}', '{_WIDE[1]}'), '{_KANA[0]}', '{_KANA[1]}') AS x0 FROM t),
v AS (SELECT u.*, nfc_normalize({ligatures}) AS x, script FROM u LEFT JOIN b ON b.book_id = u.book_id),
w AS (SELECT book_id, tok_start, ttype, CASE script {' '.join(f"WHEN '{n}' THEN {_clean_sql(n)}" for n in _TO)} ELSE x END AS clean FROM v)
SELECT DISTINCT book_id, tok_start, clean FROM w WHERE clean <> ttype"""


def _reduced_sql(text: str) -> str:
    return f"translate(regexp_replace(nfc_normalize(lower(translate({text}, '{_WIDE[0]}', '{_WIDE[1]}'))), '[^\\p{{L}}\\p{{N}}]', '', 'g'), 'асеорухіјѕһԛԝвнкмтονρυαβεζηικμτχօ', 'aceopyxijshqwbhkmtovpuabezhikmtxo')"


_BLANKS = "[\\s\\p{Z}\x1c-\x1f\x85]*"
_CHAPTER = "^" + _BLANKS + "\\p{Cf}*".join(("[CСϹＣ]", "[HНΗＨ]", "[AАΑＡ]", "[PРΡＰ]", "[TТΤＴ]", "[EЕΕＥ]", "[RＲ]")) + "\\p{Cf}*[\\s\\p{Z}]+\\p{Nd}"
SQL: dict[str, str] = {
    "p2_letters": f"""
WITH b AS (SELECT book_id, unnest(regexp_split_to_array(content, '\\n{_BLANKS}\\n{_BLANKS}')[2:]) AS t FROM book WHERE content IS NOT NULL)
SELECT book_id, sum(length(regexp_replace(t, '[^\\p{{L}}\\p{{N}}]+', '', 'g')))::BIGINT AS letters FROM b WHERE NOT regexp_matches(t, '{_CHAPTER}') GROUP BY book_id HAVING letters > 0""",
    "p5_found": _p5_sql(),
    "p8_found": f"""
WITH d AS (SELECT doc_id, {_reduced_sql('text')} AS t FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, {_reduced_sql('text')} AS t FROM heldout_item WHERE text IS NOT NULL),
dw AS (SELECT DISTINCT doc_id, substring(t, p, 60) AS w FROM (SELECT doc_id, t, unnest(range(1, length(t) - 58)) AS p FROM d WHERE length(t) >= 60)),
iw AS (SELECT DISTINCT item_id, substring(t, p, 60) AS w FROM (SELECT item_id, t, unnest(range(1, length(t) - 58)) AS p FROM i WHERE length(t) >= 60))
SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (w)""",
    "p7_found": f"SELECT doc_id FROM documents WHERE strlen(text) > {CONTAINER}",
    "p7_containers": f"""
SELECT sum(n)::BIGINT AS tokens, ceil(sum(n) / {CONTAINER})::BIGINT AS at_least, 0::BIGINT AS overfull, count(*) AS documents, sum(greatest(ceil(n / {CONTAINER}), 1))::BIGINT AS pieces, 0::BIGINT AS split_in_vain, TRUE AS tight
FROM (SELECT strlen(text) AS n FROM documents WHERE text IS NOT NULL)""",
    "p3_found": _P3 % "",
    "p3_counts": _P3 % ", n",
    "p6_found": _P6 % "ttype, mark" + " WHERE mark <> 'kept'",
    "p6_frequencies": _P6 % "ttype, occurrences, books, mark",
}

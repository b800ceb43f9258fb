"""Word tokens by Unicode word boundaries, with apostrophe and hyphen rules, folded to plain types."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireframe.functions.arrays import let, prefix_sums

_SEGMENT = regex.compile(r"(?w).+?\b|(?w).", regex.DOTALL)
#: Words that begin with an apostrophe.
_CLIPPED = regex.compile(r"(?:em|tis|twas|twill|twould)\W", regex.IGNORECASE)
APOSTROPHES, HYPHENS = "'’", "-‐"
#: Characters folded to ASCII that have no canonical decomposition.
FOLD = {
    "ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ð": "d", "ł": "l", "þ": "th", "ı": "i", "ħ": "h", "ŋ": "ng", "Æ": "AE", "Œ": "OE", "Ø": "O", "Đ": "D", "Ð": "D", "Ł": "L", "Þ": "Th", "ẞ": "SS",
    "‘": "'", "’": "'", "‚": ",", "‛": "'", "“": '"', "”": '"', "„": ",,", "«": "<<", "»": ">>", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "--", "―": "--", "…": "...", "′": "'", "″": '"', "×": "x", "÷": "/", "€": "EUR", "£": "PS", "©": "(c)", "®": "(r)", "½": "1/2", "¼": "1/4", "¾": "3/4",
}
#: Greek and Cyrillic letters folded to ASCII, in lower case; capitals follow from them.
GREEK = dict(zip("αβγδεζηθικλμνξοπρσςτυφχψω", "a b g d e z e th i k l m n x o p r s s t u ph kh ps o".split(), strict=True))
CYRILLIC = dict(zip("абвгдежзийклмнопрстуфхцчшщъыьэюяёђєѕіїјљњћўџґ", "a b v g d e zh z i i k l m n o p r s t u f kh ts ch sh shch \" y ' e iu ia io dj ie dz i yi j lj nj tsh u dzh g".split(), strict=True))
FOLD |= {k: v for t in (GREEK, CYRILLIC) for k, v in t.items()} | {k.upper(): v.capitalize() for t in (GREEK, CYRILLIC) for k, v in t.items() if k != "ς"}
TOKENS = "tok_start int, tok_end int, ttype string"


def fold(text: str) -> str:
    """``text`` with accents, ligatures, typographic marks, Greek and Cyrillic as ASCII; letters of other scripts stay."""
    if text.isascii():
        return text
    plain = "".join(FOLD.get(c, c) for c in unicodedata.normalize("NFKC", text))
    bare = "".join(FOLD.get(c, c) for c in unicodedata.normalize("NFKD", plain) if unicodedata.category(c) != "Mn" or ord(c) > 0x36F)
    return unicodedata.normalize("NFC", bare)


def to_type(word: str) -> str:
    """The type of a token: lower case, folded, without one underscore on either side."""
    w = fold(word.lower())
    w = w[1:] if w.startswith("_") else w
    return w[:-1] if w.endswith("_") else w


def segments(text: str) -> Iterator[tuple[int, int]]:
    """Word-break segments; an apostrophe never leads the word after it."""
    for m in _SEGMENT.finditer(text):
        a, z = m.span()
        if z - a > 1 and text[a] in APOSTROPHES:
            yield a, a + 1
            a += 1
        yield a, z


def _counts(text: str, a: int, z: int, parts: frozenset[str]) -> bool:
    """Whether a segment belongs to a word."""
    seg = text[a:z]
    if any(c.isalpha() or c.isdecimal() for c in seg) or seg in parts:
        return True
    before, after = text[a - 1 : a], text[z : z + 1]
    if seg in APOSTROPHES:
        return before == "s" or _CLIPPED.match(text, z) is not None
    if seg in HYPHENS:
        return all(c and (c.isalpha() or c.isnumeric() or c in parts) for c in (before, after))
    return False


def tokenise(text: str, offset: int = 0, parts: frozenset[str] = frozenset()) -> Iterator[tuple[str, int, int]]:
    """Types with their ranges: maximal runs of segments that belong to words; ``parts`` count as letters."""
    begun: int | None = None
    for a, z in segments(text):
        if _counts(text, a, z, parts):
            begun = a if begun is None else begun
        elif begun is not None:
            yield to_type(text[begun:a]), offset + begun, offset + a
            begun = None
    if begun is not None:
        yield to_type(text[begun:]), offset + begun, offset + len(text)


def parse_query(query: str) -> list[str]:
    """A phrase with ``*`` and ``?`` as LIKE patterns, one for each of its tokens."""
    out = []
    for t, _, _ in tokenise(query, parts=frozenset("*?")):
        out.append("".join({"\\": "\\\\", "%": "\\%", "_": "\\_", "*": "%", "?": "_"}.get(c, c) for c in t))
    return out


def any_words(query: str) -> list[str]:
    """The words of a query that asks for any of them: parts between white space that hold a word character."""
    return [w for w in query.split() if regex.search(r"\w", w)]


#: Words too frequent to look up a phrase by.
STOP_WORDS = frozenset("the and to of a i in he was that".split())


def anchor(patterns: list[str]) -> int:
    """The position of the pattern to look up first: no stop word, then the longest, then the first."""
    score = [(0 if p in STOP_WORDS else 100) + len(p.replace("%", "").replace("_", "")) for p in patterns]
    return max(range(len(score)), key=lambda i: (score[i], -i))


def token_table(book: DataFrame) -> DataFrame:
    """``book_id, tok_start, tok_end, ttype`` of whole contents; a null content has no tokens."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i, content in zip(pdf["book_id"], pdf["content"], strict=True):
                rows = list(tokenise(content))
                for k in range(0, len(rows), 50_000):
                    t, a, z = zip(*rows[k : k + 50_000], strict=True)
                    yield pd.DataFrame({"book_id": i, "tok_start": a, "tok_end": z, "ttype": t})

    return book.where("content is not null").select("book_id", "content").mapInPandas(scan, "book_id long, " + TOKENS)


#: Words by letters and digits alone, the same in any engine.
PORTABLE = r"[\p{L}\p{N}]+(?:['’.\-][\p{L}\p{N}]+)*"


def portable_tokens(df: DataFrame, record: str, text: str) -> DataFrame:
    """``record, position, ttype`` (from 1) inside the JVM: lower case, no folding."""
    words = F.regexp_extract_all(F.lower(text), F.lit(PORTABLE), F.lit(0))
    return df.select(record, F.posexplode(words).alias("p", "ttype")).select(record, (F.col("p") + 1).alias("position"), "ttype")


def portable_ranges(df: DataFrame, record: str, text: str) -> DataFrame:
    """``record, position, tok_start, tok_end, word``: portable words as they stand, with their ranges."""
    t = F.col(text)

    def ranges(words):
        return let(F.split(t, PORTABLE, -1), lambda g: let(F.transform(words, lambda w, i: F.length(F.get(g, i)) + F.length(w)), lambda s: let(prefix_sums(s), lambda p: F.transform(words, lambda w, i: F.struct(w.alias("word"), (F.get(p, i) + F.length(F.get(g, i))).alias("a"))))))

    each = df.where(t.isNotNull()).select(record, F.posexplode(let(F.regexp_extract_all(t, F.lit(PORTABLE), F.lit(0)), ranges)).alias("p", "x"))
    return each.select(record, (F.col("p") + 1).alias("position"), F.col("x.a").alias("tok_start"), (F.col("x.a") + F.length("x.word")).alias("tok_end"), F.col("x.word").alias("word"))

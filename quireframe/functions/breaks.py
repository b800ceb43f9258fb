"""Sentence boundaries by the Unicode rules, with suppression after abbreviations."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import regex
from pyspark.sql import SparkSession

#: Abbreviations of the public locale data for English after which a point breaks nothing (a part; see ``suppressions``).
ENGLISH = frozenset(["Mr.", "Mrs.", "Ms.", "Prof.", "Rev.", "Capt.", "Col.", "Lt.", "Maj.", "Sgt.", "Gen.", "Hon.B.A.", "Etc.", "E.g.", "I.e.", "vs.", "Jr.", "Sr.", "Cmdr.", "Comdr.", "Corp.", "Adj.", "Brig.", *(f"{c}." for c in "FGOQTXZ")])
_END = regex.compile(r"(?P<term>[.․﹒．!?‼⁇⁈⁉։؟۔।॥።፧。！？｡]+)[\"'\p{Ps}\p{Pe}\p{Pi}\p{Pf}]*(?P<space>[^\S\n]*)(?P<para>\n)?")
_GOES_ON = regex.compile(r"[,\-:–—՝،;、，：；]")
_FIRST = regex.compile(r"[^\p{L}\n.!?]*(\p{Ll})")


def suppressions(spark: SparkSession) -> frozenset[str]:
    """The list of the locale data that comes with Spark's own libraries; an error if it can't be read there.

    An entry that others go on from (``E.`` of ``E.g.``) suppresses nothing by itself, as in that library's iterator.
    """
    jvm = spark._jvm
    loader = jvm.java.lang.Thread.currentThread().getContextClassLoader()
    data = jvm.com.ibm.icu.util.UResourceBundle.getBundleInstance("com/ibm/icu/impl/data/icudata/brkitr", "en", loader)
    words = data.get("exceptions").get("SentenceBreak")
    every = {words.getString(i) for i in range(words.getSize())}
    return frozenset(w for w in every if not any(x != w and x.startswith(w) for x in every))


def _suppressed(text: str, point: int, words: list[str], lengths: list[int]) -> bool:
    """Whether what ends with the point at ``point`` is one of ``words`` (sorted), with no letter before it."""
    for n in lengths:
        a = point + 1 - n
        if a < 0 or (a > 0 and (text[a - 1].isalnum() or text[a - 1] == "_")):
            continue
        w = text[a : point + 1]
        i = bisect.bisect_left(words, w)
        if i < len(words) and words[i] == w:
            return True
    return False


def boundaries(text: str, suppress: frozenset[str] = ENGLISH) -> Iterator[int]:
    """Places within ``text`` where a sentence begins after another; line breaks are spaces, blank lines end sentences."""
    flat = regex.sub(r"\r|\n(?!\n)", " ", text)
    words, lengths = sorted(suppress), sorted({len(w) for w in suppress})
    out = {m.end() for m in regex.finditer(r"\n+\s*", flat)}
    for m in _END.finditer(flat):
        z = m.end("space")
        if z >= len(flat) or m["para"]:
            continue
        if _GOES_ON.match(flat, z) or flat[z] in ".!?":
            continue
        if m["term"][-1] in ".․﹒．":
            plain = m.end() == m.end("term")
            if plain and (flat[z].isdigit() or flat[z].isalpha() and m.start() and flat[m.start() - 1].isalpha() and flat[z].isupper()):
                continue
            if _FIRST.match(flat, z) or _suppressed(flat, m.end("term") - 1, words, lengths):
                continue
        out.add(z)
    yield from sorted(b for b in out if 0 < b < len(flat))

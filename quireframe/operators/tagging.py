"""Regions of plain texts: title and author, parts, chapters, paragraphs, sentences, speech and what interrupts it.

A text is one string, and speech may run on from one paragraph to the next, so a book is tagged as a whole; books are
independent of each other.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator, Mapping, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame

from quireframe.functions.breaks import ENGLISH, boundaries
from quireframe.functions.tokenise import _counts, segments
from quireframe.schema import RCLASS_IDS

#: What heads a text, a part and a chapter.
_HEAD = re.compile(r"(.+)\n(.+)\n\n")
_PART = re.compile(r"^(?:PART|BOOK) [0-9IVXLC]+\..*", re.MULTILINE)
_CHAPTER = re.compile(r"^(?:APPENDIX|INTRODUCTION|PREFACE|CHAPTER|CONCLUSION|PROLOGUE|PRELUDE|EPILOGUE|MORAL)\s?[0-9IVXLC]*\..*", re.MULTILINE)
#: Marks that open speech, with those that close it; those that are too often apostrophes to go by length;
#: how many words make a quotation speech.
MARKS = {"“": "”", "‘": "’", '"': '"', "'": "'"}
WEAK_MARKS = "’'"
LENGTH = 5
#: Punctuation that shows speech, with where it is looked for: from and up to how many characters after
#: the opening mark (o) or the closing mark's end (c).
SIGNS = (
    ("o", -4, 0, re.compile(r"(?:--|\(|,|:|;)\s*$")),
    ("o", 1, 6, re.compile(r"^\s*--")),
    ("c", -5, -1, re.compile(r"--\s*$|[,?.!-;_]$")),
    ("c", 0, 5, re.compile(r"^\s*--")),
)


class Region(NamedTuple):
    start: int
    end: int
    value: int | None = None


def _trim(text: str, a: int, z: int, value: int | None = None) -> Iterator[Region]:
    """The range without white space at its edges, if anything is left."""
    piece = text[a:z]
    body = piece.strip()
    if body:
        a += len(piece) - len(piece.lstrip())
        yield Region(a, a + len(body), value)


def _gaps(taken: Sequence[tuple[int, int]], length: int) -> Iterator[tuple[int, int]]:
    """What lies between ranges in their order, before the first and after the last."""
    last = 0
    for a, z in taken:
        if a > last:
            yield last, a
        last = z
    if length > last:
        yield last, length


def head(text: str) -> dict[str, list[Region]]:
    m = _HEAD.match(text)
    return {"metadata.title": [Region(*m.span(1))], "metadata.author": [Region(*m.span(2))]} if m else {}


def headings(text: str) -> dict[str, list[Region]]:
    return {name: [Region(*m.span(), i) for i, m in enumerate(form.finditer(text), 1)] for name, form in (("chapter.part", _PART), ("chapter.title", _CHAPTER))}


def chapter_texts(text: str, tags: Mapping[str, Sequence[Region]]) -> list[Region]:
    """The complement of all headings, numbered by the last chapter heading that begins before."""
    heads = [(r.start, r.end) for name in ("metadata.title", "metadata.author", "chapter.part", "chapter.title") for r in tags.get(name, ())]
    titles = sorted((r.start, -r.end, r.value or 0) for r in tags.get("chapter.title", ()))
    numbers = [0, *(value for _, _, value in titles)]
    between = _gaps(sorted(heads, key=lambda h: (h[0], -h[1])), len(text))
    return [r for a, z in between for r in _trim(text, a, z, numbers[bisect.bisect_left(titles, (a,))])]


def paragraphs(text: str, chapters: Sequence[Region]) -> list[Region]:
    out = []
    for c in chapters:
        n, a = 0, c.start
        for piece in text[c.start : c.end].split("\n\n"):
            for r in _trim(text, a, a + len(piece)):
                n += 1
                out.append(r._replace(value=n))
            a += len(piece) + 2
    return out


def sentences(text: str, chapters: Sequence[Region], suppress: frozenset[str] = ENGLISH) -> list[Region]:
    cuts = list(boundaries(text, suppress))
    out = []
    for c in chapters:
        inner = cuts[bisect.bisect_right(cuts, c.start) : bisect.bisect_left(cuts, c.end)]
        n = 0
        for a, z in zip([c.start, *inner], [*inner, c.end], strict=True):
            for r in _trim(text, a, z):
                n += 1
                out.append(r._replace(value=n))
    return out


class Mark(NamedTuple):
    """A quotation mark in a paragraph: its place, the words before it, and whether the paragraph begins with it."""

    char: str
    start: int
    end: int
    words: int
    leads: bool


def marks(text: str, paras: Sequence[Region]) -> Iterator[Mark | bool]:
    """The quotation marks of all paragraphs; before those of each paragraph, whether speech may run on into it.

    It may where the paragraph begins with an opening mark or an indent. What the tokeniser makes a word (an apostrophe
    within one) is no mark.
    """
    pieces = list(segments(text))
    ends = [z for _, z in pieces]
    known = {*MARKS, *MARKS.values()}
    words = 0
    for p in paras:
        yield text[p.start] in MARKS or text.endswith("   ", 0, p.start)
        for a, z in pieces[bisect.bisect_right(ends, p.start) : bisect.bisect_right(ends, p.end)]:
            if _counts(text, a, z, frozenset()):
                words += 1
            elif (char := text[max(a, p.start) : z]) in known:
                yield Mark(char, a, z, words, a <= p.start)


def is_speech(text: str, opening: Mark, closing: Mark) -> bool:
    """Whether a pair of marks shows speech: by its length, or by a sign around or within it."""
    if closing.words - opening.words >= LENGTH and opening.char not in WEAK_MARKS:
        return True
    at = {"o": opening.start, "c": closing.end}
    # A window that would begin before the text is empty.
    return any(sign.search(text[at[side] + first : at[side] + last]) for side, first, last, sign in SIGNS if at[side] + first >= 0)


def quotes(text: str, paras: Sequence[Region]) -> tuple[list[Region], list[Region]]:
    """Speech, and speech within it: marks are paired by level, and a pair stands if it shows speech.

    At each level one mark is open. A mark closes the innermost level that waits for it; otherwise it opens the inner
    level if speech with another closing mark is open, else the outer one. While speech runs on, a mark that leads a
    paragraph only repeats the opening one. The inner level ends with its paragraph and with speech that stands.
    """
    stands: tuple[list[Region], list[Region]] = ([], [])
    waiting: list[Mark | None] = [None, None]
    for m in marks(text, paras):
        if isinstance(m, bool):
            waiting = [waiting[0] if m else None, None]
            continue
        repeats = m.leads and waiting[0] is not None
        closes = [k for k, w in enumerate(waiting) if w is not None and MARKS[w.char] == m.char and not (repeats and k == 0)]
        if closes:
            level = closes[-1]
            opening, waiting[level] = waiting[level], None
            if is_speech(text, opening, m):
                stands[level].append(Region(opening.start, m.end))
                waiting = [waiting[0], waiting[1] if level else None]
        elif m.char in MARKS and not repeats:
            outer = waiting[0]
            waiting[int(outer is not None and MARKS[outer.char] != MARKS[m.char])] = m
    return stands


def nonquotes(text: str, chapters: Sequence[Region], speech: Sequence[Region]) -> list[Region]:
    outside = _gaps([(c.start, c.end) for c in chapters], len(text))
    taken = sorted([(r.start, r.end) for r in speech] + list(outside), key=lambda r: (r[0], -r[1]))
    return [r for a, z in _gaps(taken, len(text)) for r in _trim(text, a, z)]


def suspensions(text: str, other: Sequence[Region], paras: Sequence[Region], sents: Sequence[Region]) -> tuple[list[Region], list[Region]]:
    """Short and long interruptions of speech: narration that neither begins a paragraph or, in upper case, a sentence, nor holds a sentence's end."""
    para_starts, sent_starts = {p.start for p in paras}, {s.start for s in sents}
    stops = sorted(s.end - 1 for s in sents[1:])
    short: list[Region] = []
    long: list[Region] = []
    for r in other:
        if r.start in para_starts:
            continue
        first = re.match(r"(?:\W|_)*(.)", text[r.start : r.end])
        if r.start in sent_starts and first and first[1].isupper():
            continue
        i = bisect.bisect_right(stops, r.start)
        if i < len(stops) and stops[i] < r.end:
            continue
        n = sum(any(c.isalpha() or c.isdecimal() for c in text[r.start + a : r.start + z]) for a, z in segments(text[r.start : r.end]))
        if n >= 5:
            long.append(r)
        elif n:
            short.append(r)
    return short, long


def tag(text: str, given: Mapping[str, Sequence[Region]] | None = None, suppress: frozenset[str] = ENGLISH) -> dict[str, list[Region]]:
    """All regions of a text by class. Classes that are ``given`` stand as they are."""
    tags: dict[str, list[Region]] = {k: sorted(v) for k, v in (given or {}).items() if v}

    def put(found: Mapping[str, Sequence[Region]]) -> None:
        for k, v in found.items():
            tags.setdefault(k, list(v))

    put(head(text))
    put(headings(text))
    put({"chapter.text": chapter_texts(text, tags)} if "chapter.text" not in tags else {})
    put({"chapter.paragraph": paragraphs(text, tags["chapter.text"])})
    put({"chapter.sentence": sentences(text, tags["chapter.text"], suppress)})
    if "quote.quote" not in tags:
        outer, inner = quotes(text, tags["chapter.paragraph"])
        put({"quote.quote": outer, "quote.embedded": inner})
    put({"quote.nonquote": nonquotes(text, tags["chapter.text"], tags["quote.quote"])})
    if "quote.suspension.short" not in tags and "quote.suspension.long" not in tags:
        short, long = suspensions(text, tags["quote.nonquote"], tags["chapter.paragraph"], tags["chapter.sentence"])
        put({"quote.suspension.short": short, "quote.suspension.long": long})
    return tags


def tag_books(book: DataFrame, suppress: frozenset[str] = ENGLISH) -> DataFrame:
    """``book_id, rclass_id, r_start, r_end, rvalue`` of every book with a content.

    A column ``given`` (an array of structs rclass, start, end, rvalue), if there is one, holds regions that stand.
    """
    has = "given" in book.columns
    schema = "book_id long, rclass_id int, r_start int, r_end int, rvalue int"

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                given: dict[str, list[Region]] = {}
                for g in row.given if has and row.given is not None else ():
                    given.setdefault(g["rclass"], []).append(Region(g["start"], g["end"], g["rvalue"]))
                rows = [(row.book_id, RCLASS_IDS[k], r.start, r.end, r.value) for k, rs in tag(row.content, given, suppress).items() if k in RCLASS_IDS for r in rs]
                yield pd.DataFrame(rows, columns=["book_id", "rclass_id", "r_start", "r_end", "rvalue"]).astype({"rvalue": "Int32"})

    return book.where("content is not null").select("book_id", "content", *(["given"] if has else [])).mapInPandas(scan, schema)

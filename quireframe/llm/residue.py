"""Template residue and error-page text: unfilled slots, filler, error pages, stand-in pages and script notices.

A line is judged by what it is made of, not by its wording: its words are held against a lexicon of ideas (place, negation,
find, failure, refusal, script, requirement, remedy, waiting, template nouns and verbs) in many languages, and what counts
is which ideas meet in it and how much of it they cover. A sentence that only speaks of an error tells a story in other
words and is covered poorly. Slots are told by their grammar, status lines and program messages by their form.

Lines that show a single idea, and whole responses in words that the lexicon lacks, are decided by combined evidence: the
same body, numbers aside, under titles and addresses it shares no term with, how many of these there are and on how many
hosts, against how much the body says. No count is absolute and no length ends it.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireframe.llm.lexicon import NEUTRAL, TERMS, WEB
from quireframe.session import cut

_NAME = "[\\p{L}_][\\p{L}\\p{N}_.-]{0,60}"
_ARG = f"\\s{{0,3}}{_NAME}(?:\\s{{0,3}}\\|\\s{{0,3}}\\w+)?\\s{{0,3}}"
#: Slots of the usual template languages, in lower case.
SLOTS = [
    f"\\{{{{2,3}}{_ARG}\\}}{{2,3}}",
    f"[$#]\\{{{_ARG}\\}}",
    f"(?<![\\p{{L}}\\p{{N}}\\\\$#%={{])(?<!= )\\{{{_NAME}\\}}(?!\\}})",
    f"<%[=-]?{_ARG}-?%>",
    f"<\\?=?(?:php)?\\s{{0,3}}(?:echo )?\\${_NAME};?\\s{{0,3}}\\?>",
    f"\\{{%-?\\s{{0,3}}\\w+(?:\\s+{_NAME})?\\s{{0,3}}-?%\\}}",
    f"\\[%-?{_ARG}-?%\\]",
    f"<<{_ARG}>>",
    f"&lt;{_ARG}&gt;",
    f"@@{_NAME}@@",
    "(?<![\\p{L}\\p{N}_])__\\p{L}[\\p{L}\\p{N}.-]*(?:_[\\p{L}\\p{N}.-]+)*__(?![\\p{L}\\p{N}_])",
    f"%\\({_NAME}\\)[sd]",
    f"(?<![\\p{{L}}\\p{{N}}%])%{{1,2}}{_NAME}%{{1,2}}(?![\\p{{L}}\\p{{N}}%])",
    f"\\*\\|{_NAME}(?::{_NAME})?\\|\\*",
    "(?<![\\p{L}\\p{N}$])\\$\\p{L}[\\p{L}\\p{N}]*(?:[_.]\\p{L}[\\p{L}\\p{N}]*)+\\$(?![\\p{L}\\p{N}$])",
    f"\\[\\[{_ARG}\\]\\]",
    f"\\[{_NAME} here\\]",
    "[\\[<](?:insert|enter|add|your) [^\\[\\]<>\n]{1,60}[\\]>]",
    "\\[\\p{L}+(?:[_.]\\p{L}+)+\\]",
]
SLOT = f"(?=[{{$#<&@_%\\[*])(?<![\"“‘'`«])(?:{'|'.join(f'(?:{p})' for p in SLOTS)})(?![\"”’'`»])"

#: Words of the pseudo-Latin passage that fillers are made from, by their beginnings; four of them stand close together.
ANCHORS = "lorem|ipsum|dolor|amet|consec|adipisc|eiusmod|tempor|tempus|incididunt|labor[eio]|aliqu|veniam|nostrud|ullamco|commodo|velit|nulla|mollit|cupidat|proident|officia|deserunt|vestibul|pellentesq|curabit|suspendiss|maecen|phasell|praesent|vivamus"
LATIN_RUN = f"(?<!\\p{{L}})(?=[lidaceptnuvmos])(?:{ANCHORS})\\p{{L}}{{0,8}}(?:[\\s,.;:]+(?:\\p{{L}}+[\\s,.;:]+){{0,3}}?(?:{ANCHORS})\\p{{L}}{{0,8}}){{3}}"
USUAL_LATIN = ["ipsum", "lorem", "dolor", "amet", "consec", "velit", "tempor", "aliqu", "adipisc"]
LEADERS = "\\A[\\s._*=~-]{12,}\\z(?<=[._*=~-]\\s{0,40})"
#: A line of nothing but tokens that stand for text to come.
_TOKEN = "(?:x{3,}|blah|bla|tk|tktk|tbd|tba|tbc|todo|fixme|asdf|asdfgh|jkl|qwerty|foo|bar|baz|n/a|_{4,})"
TOKENS = f"(?m)^[\\s\\[(<{{*\"“-]{{0,8}}(?:{_TOKEN}(?![\\p{{L}}_])[\\s,.;:!…–-]*)+[\\])>}}*\"”\\s]{{0,8}}$"

#: Messages of programs, by their form: a status line, a stack's frame, a place in a source.
STATUS = "(?:http/\\d(?:\\.\\d)?\\s+)?[45]\\d\\d"
PROGRAM = "(?m)^\\s{0,8}(?:traceback \\(most recent call last\\)|file \"[^\"\n]+\", line \\d+|at [\\p{L}\\p{N}_$.<>]+\\([^()\n]*:\\d+\\)|(?:uncaught |unhandled )?(?:[\\p{L}_]+[.:])*[\\p{L}_]*(?:error|exception): \\S|exception in thread )| in /?\\S{1,200} on line \\d+[.\\s]*$"

#: Ideas of which one must be there for a line to be looked at; the others only say what the line is about.
LEADING = frozenset({"script", "human", "failure", "refusal", "absence", "offer", "waiting", "verb", "stand_in_for", "login", "code"})
#: Scripts that put no spaces between words.
_D = "฀-๿぀-ヿ㐀-鿿가-힣"
_DENSE = regex.compile(f"[{_D}]+")
_STATUS = r"(?<![\p{N}.#:/-])[45]\d\d(?![\p{N}.,:-]?\p{N})"
_WORD = regex.compile(f"[{_D}]+|(?:(?![{_D}])[\\p{{L}}\\p{{M}}])+|{_STATUS}")
_SPACED = regex.compile(f"[\\p{{L}}\\p{{M}}]+|{_STATUS}")
_ASCII = re.compile(r"[A-Za-z]+|(?<![\d.#:/-])[45]\d\d(?![\d.,:-]?\d)")
#: Mark-up, addresses, names of files and functions, names in quotation marks or in brackets at the end: the message's own data.
_DATA = regex.compile(r"</?[a-z][a-z0-9]*(?:\s[^<>]*=[^<>]*)?/?>|https?://\S+|\S*[/\\]\S+[/\\.]\S*|[\p{L}\p{N}_]+\(\)|(?<![\p{L}\p{N}])['\"‘“][\p{L}\p{N}_.-]+['\"’”]|#[\p{N}.]+|(?<=\S\s)\([^()\s]+\)\s*$")


def words_of(text: str) -> list[str]:
    """Words, runs of dense scripts and status codes, in their order."""
    return (_ASCII if text.isascii() else _WORD if _DENSE.search(text) else _SPACED).findall(text)


_MAY_HOLD_DATA = re.compile(r"[<>/\\(#]|['\"‘“]\S+['\"’”]")
_PATH = regex.compile(r"(?<!\S)/[\p{L}\p{N}_./-]{3,}")


class Ideas:
    """The lexicon, ready for looking words up: single words, beginnings, words that go together, and dense scripts."""

    def __init__(self) -> None:
        self.word: dict[str, str | None] = dict.fromkeys(NEUTRAL, "")
        self.stems: dict[str, str] = {}
        self.phrases: dict[str, list[tuple[tuple[str, ...], str]]] = {}
        self.dense: dict[str, str] = {w: "" for w in NEUTRAL if _DENSE.search(w)}
        self.known: dict[str, str | None] = {}
        self.quiet: set[str] = set()  # words seen that make no line worth a look
        for idea, words in TERMS.items():
            for w in words:
                if _DENSE.search(w):
                    self.dense[w.replace(" ", "")] = idea
                    continue
                parts = tuple(words_of(w))
                if len(parts) > 1:
                    self.phrases.setdefault(parts[0], []).append((parts, idea))
                elif w.endswith("*"):
                    self.stems.setdefault(parts[0], idea)
                elif self.word.get(parts[0]) in (None, ""):
                    self.word[parts[0]] = idea
        for of in self.phrases.values():
            of.sort(key=lambda x: -len(x[0]))
        self.longest, self.shortest = max(map(len, self.stems)), min(map(len, self.stems))
        self.reach = max(map(len, self.dense))
        self.web, self.web_stems = frozenset(w for w in WEB if w[-1] != "*"), tuple(w[:-1] for w in WEB if w[-1] == "*")

    def of(self, word: str) -> str | None:
        """The idea of a word; '' for one that says nothing, None for one that is not known."""
        if word in self.known:
            return self.known[word]
        idea = "code" if word[0] in "45" and word.isdecimal() else self.word.get(word)
        if idea is None:
            idea = next((self.stems[word[:n]] for n in range(min(self.longest, len(word)), self.shortest - 1, -1) if word[:n] in self.stems), None)
        if len(self.known) > 500_000:
            self.known.clear()
        self.known[word] = idea
        return idea

    def leads(self, words: list[str]) -> bool:
        """Whether one of the words makes the line worth a look."""
        own = {*words}
        for w in own & self.phrases.keys():
            if any(idea in LEADING and own.issuperset(parts) for parts, idea in self.phrases[w]):
                return True
        for w in own - self.quiet:
            if _DENSE.match(w):
                if any(i in LEADING or i == "place" for i, _ in self.parts(w)):
                    return True
            elif self.of(w) in LEADING or w in self.web or w.startswith(self.web_stems):
                return True
            if len(self.quiet) > 500_000:
                self.quiet.clear()
            self.quiet.add(w)
        return False

    def parts(self, run: str) -> list[tuple[str | None, int]]:
        """A run of a dense script as ideas and numbers of letters, the longest terms first."""
        out, i = [], 0
        while i < len(run):
            for n in range(min(self.reach, len(run) - i), 0, -1):
                if (idea := self.dense.get(run[i : i + n])) is not None:
                    out.append((idea, n))
                    i += n
                    break
            else:
                out.append((None, 1))
                i += 1
        return out

    def measure(self, line: str) -> tuple[dict[str, int], float, int]:
        """How often each idea occurs in a line, how many letters no idea covers (those of dense scripts weigh three), and
        how many words say nothing."""
        words = words_of(_DATA.sub(" ", line) if _MAY_HOLD_DATA.search(line) else line)
        found: dict[str, int] = {}
        rest, empty, i, n = 0.0, 0, 0, 0
        spaced = _DENSE.search(line) is None
        while i < len(words):
            if spaced and max(rest / 5, empty / 2.5) > n + len(words) - i:
                return {}, rest, empty  # whatever follows, it is too little
            w = words[i]
            step = 1
            idea = self.of(w)
            for parts, of in self.phrases.get(w, ()):
                if tuple(words[i : i + len(parts)]) == parts:
                    idea, step = of, len(parts)
                    break
            if idea:
                found[idea] = found.get(idea, 0) + 1
                n += 1
            elif idea is not None:
                empty += 1
            elif not spaced and _DENSE.match(w):
                for part, _ in self.parts(w):
                    if part is None:
                        rest += 3
                    elif part:
                        found[part] = found.get(part, 0) + 1
                        n += 1
            else:
                rest += len(w)
            i += step
        return found, rest, empty


@functools.cache
def ideas() -> Ideas:
    return Ideas()


def line_kind(line: str) -> str | None:
    """What a line (in lower case) is: 'notice', 'error', 'filler', 'stand_in', or 'weak' where only evidence can tell, else None.

    An idea weighs as much as five letters that no idea covers; ideas must be three in ten of the words they
    stand among. A line that tells a story is none.
    """
    has, rest, empty = ideas().measure(line)
    n = sum(has.values())
    if not n or n < 0.3 * (n + empty) or "story" in has:
        return None
    covered, different, alone = 5 * n / (5 * n + rest), len(has), rest == 0
    h = has.__contains__
    again = h("remedy") or h("login")
    notice = h("script") and (h("need") or h("negation") or h("human") or h("refusal")) or h("human") and (h("need") or h("place") or again or h("negation") or h("finding") or has["human"] > 1)
    lost = h("negation") and h("place") and (h("finding") or h("offer") or again or h("refusal")) or h("absence") and (h("place") or again or h("failure") or h("code") or alone)
    failed = (h("failure") or h("refusal") or h("code")) and different >= 2
    stand_in = h("waiting") and (h("place") or h("noun") or h("remedy") or alone) or h("negation") and h("noun") and h("offer")
    filler = h("stand_in_for") and (h("noun") or h("place") or alone) or (h("noun") or h("place")) and h("verb") and (h("here") or alone) or h("verb") and h("here") and alone
    if covered >= 0.6 and notice:
        return "notice"
    if covered >= 0.65 and (lost or failed):
        return "error"
    if covered >= 0.8 and h("login") and (h("place") or h("need")):
        return "notice"
    if covered >= 0.8 and filler:
        return "filler"
    if covered >= 0.65 and stand_in:
        return "stand_in"
    weak = any(map(h, ("failure", "refusal", "absence", "waiting", "stand_in_for", "verb"))) or h("code") and alone
    return "weak" if covered >= 0.5 and (weak or notice or lost or failed) else None


def _hash(*parts: str) -> int:
    return xxhash.xxh3_64_intdigest("\0".join(parts)) - (1 << 63)


def _size(words: list[str]) -> int:
    """How many words there are; three letters of a dense script count as one."""
    return sum(-(-len(w) // 3) if _DENSE.match(w) else 1 for w in words)


_TERM = regex.compile(r"[\p{L}\p{M}]+|\p{N}+")


def _terms(text: str) -> list[str]:
    """The words of a text; numbers are all alike."""
    return ["0" if w[0].isnumeric() else w for w in _TERM.findall(text)]


def _stands(word: str, text: str) -> bool:
    return regex.search(rf"(?<![\p{{L}}\p{{M}}]){word}(?![\p{{L}}\p{{M}}])", text) is not None


UNITS = "d long, h long, u long, reasons array<string>, k long, words int, share double"


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts (d, t, h, a, given, told) to what is told of each, with the responses that evidence is gathered for."""
    known = ideas()
    for batch in batches:
        out: list[tuple] = []
        for d, text, host, address, given, told in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            lines = [x for x in text.split("\n") if x.strip()]
            found = {}
            for x in lines:
                if known.leads(words_of(x)) and (kind := line_kind(x)):
                    found.setdefault(kind, []).append(x)
            reasons = sorted({*told, *found} - {"weak"})
            title, body = (given, text) if given is not None else (lines[0], text[text.find(lines[0]) + len(lines[0]) :]) if len(lines) > 1 else ("", text)
            named = address or (m[0] if (m := _PATH.search(text)) else "")
            under, host = _hash(title, named), _hash(host or "")
            rows = []
            if len(title) <= len(body) and (told_by := [w for w in {*_terms(title), *_terms(named)} if len(w) > 1]):
                body = _PATH.sub(" ", body)
                if not any(w in body and _stands(w, body) for w in told_by) and (words := _terms(body)):
                    rows.append((_hash(" ".join(words)), _size(words), 0.0))
            for x in dict.fromkeys(found.get("weak", ())):
                w = _terms(x)
                rows.append((_hash("line", " ".join(w)), _size(w), len(x) / len(text)))
            if not rows and reasons:
                rows = [(None, None, None)]
            out += [(d, host, under, reasons, *r) for r in rows]
        if out:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.int64(), pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["d", "h", "u", "reasons", "k", "words", "share"])


def residue(df: DataFrame, doc: str, text: str, host: str | None = None, address: str | None = None, title: str | None = None) -> DataFrame:
    """``doc, reasons``: each text that is or holds residue, with the sorted names of what found it.

    ``reasons`` are the detectors ('slot', 'filler', 'error', 'stand_in', 'notice') and 'repeated' for what combined
    evidence shows. Evidence is gathered for whole responses (the text without its title, which is the first line unless
    there is a column for it) whose words neither the title nor the slug of the address shares (a column, or the path
    that the text names), and for lines that show an idea but not enough of it. ``log2(hosts) + log2(titles)`` over all
    that have the same words, numbers aside, stands against ``log2(1 + words)`` that they say: a whole response must
    stand on two hosts and under two titles at least and outweigh its own words, a line on two hosts or under two
    titles, with the more weight the more of the text it is.

    ``doc`` must be an integer column. Null and blank texts are no cases; a null host counts as none; repeated rows give one row; an empty table gives no
    rows; other columns are ignored. Texts are scanned once; of each text only hashes and numbers are written to the
    shared folder and shuffled. Nothing is limited in length or number.
    """
    low = F.regexp_replace(F.lower(F.col(text)), "[\\x{a0}\\x{202f}\\x{3000}\\r]", " ")
    nothing = F.lit(None).cast("string")
    rows = df.where(F.col(text).isNotNull()).select(F.col(doc).alias("d"), F.explode(F.array(low)).alias("t"), (F.col(host) if host else nothing).alias("h"), (F.lower(F.col(address)) if address else nothing).alias("a"), (F.lower(F.col(title)) if title else nothing).alias("given"))
    latin = reduce(lambda a, b: a | b, [F.col("t").contains(w) for w in USUAL_LATIN]) & F.col("t").rlike(LATIN_RUN)
    tests = {"slot": F.col("t").rlike(SLOT), "filler": F.col("t").rlike(TOKENS) | F.col("t").rlike(LEADERS) | latin, "error": F.col("t").rlike(PROGRAM)}
    told = F.array_compact(F.array(*(F.when(test, n) for n, test in tests.items())))
    seen = cut(rows.where(F.trim("t") != "").select(F.col("d").cast("long").alias("d"), "t", "h", "a", "given", told.alias("told")).mapInArrow(_units, UNITS))

    many = seen.where("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("k")
    again = seen.where("k is not null").join(many, "k", "left_semi")
    spread = again.groupBy("k").agg(F.log2(F.approx_count_distinct("h")).alias("hosts"), F.log2(F.approx_count_distinct("u")).alias("titles"))
    evidence, says = F.col("hosts") + F.col("titles"), F.log2(F.col("words") + 1.0)
    whole = (F.col("share") == 0) & (F.least("hosts", "titles") >= 1) & (evidence > says)
    line = (F.col("share") > 0) & (F.greatest("hosts", "titles") >= 1) & (F.col("share") * (2 + evidence) > says)
    repeated = again.join(spread, "k").where(whole | line).select("d", F.array(F.lit("repeated")).alias("reasons"))
    found = seen.where("size(reasons) > 0").select("d", "reasons").unionByName(repeated)
    return found.groupBy("d").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("reasons")))).alias("reasons")).withColumnRenamed("d", doc)

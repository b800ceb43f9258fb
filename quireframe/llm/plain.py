"""Text that looks the same in one form: width, composition, ligatures, invisible characters, apostrophes, look-alikes.

A quick check inside the scan lets stable text pass untouched. Only unstable segments are normalised, each from the
starter it leans on, and spliced back.
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quireframe.functions.arrays import let
from quireframe.functions.tokenise import tokenise

#: Scripts told apart, as Unicode ranges; the ideographic one stands for all that write Chinese characters or kana.
SCRIPTS = {
    "latin": "A-Za-zªº\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u1e00-\u1eff",
    "cyrillic": "\u0400-\u052f",
    "greek": "\u0370-\u03ff\u1f00-\u1fff",
    "armenian": "\u0530-\u058f",
    "arabic": "\u0600-\u06ff\u0750-\u077f",
    "hebrew": "\u0590-\u05ff",
    "devanagari": "\u0900-\u097f",
    "ethiopic": "\u1200-\u139f",
    "hangul": "\u1100-\u11ff\uac00-\ud7a3",
    "thai": "\u0e00-\u0e7f",
    "georgian": "\u10a0-\u10ff",
    "ideographic": "\u3040-\u30ff\u3400-\u9fff",
}
#: Letters that can't be told apart in print, lower and upper case, to Latin.
TO_LATIN_STRICT = {
    "cyrillic": dict(zip("асеорухіјѕАВСЕНІЈКМОРЅТХУ", "aceopyxijsABCEHIJKMOPSTXY", strict=True)),
    "greek": dict(zip("ονΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ovABEZHIKMNOPTYX", strict=True)),
    "armenian": dict(zip("օ", "o", strict=True)),
}
#: Letters that pass for Latin ones inside a word that is Latin otherwise.
TO_LATIN_LOOSE = {
    "cyrillic": dict(zip("һԛԝӏ", "hqwl", strict=True)),
    "greek": dict(zip("αικρυχγ", "aikpuxy", strict=True)),
    "armenian": dict(zip("սոհցզյ", "unhgqj", strict=True)),
}
APOSTROPHES = "\u2018\u2019\u201b\u02bc\u02bb\u02b9\u02c8\u2032\u00b4\u0060\uff07\ua78b\ua78c"
HYPHENS = "\u2010\u2011\u2012\u2212\ufe63\uff0d\u2043\u058a"
_INVISIBLE = "\\p{Cf}\\p{Cc}\\p{Z}\u034f\u115f\u1160\u17b4\u17b5\u180b-\u180e\u3164\ufe00-\ufe0f\uffa0"
_COMPATIBLE = "\u0132\u0133\u01c4-\u01cc\u01f1-\u01f3\u017f\u0149\ufb00-\ufb06\ufb13-\ufb17\ufb1d-\ufdff\ufe70-\ufefc\uff01-\uffee"


def _ranges(codes: list[int]) -> str:
    out, i = [], 0
    while i < len(codes):
        j = i
        while j + 1 < len(codes) and codes[j + 1] == codes[j] + 1:
            j += 1
        out.append(f"\\x{{{codes[i]:x}}}" + (f"-\\x{{{codes[j]:x}}}" if j > i else ""))
        i = j + 1
    return "".join(out)


@functools.cache
def unstable_class() -> str:
    """A Java character class of what NFC's quick check answers with No or Maybe, from the character database."""
    no, maybe = [], set()
    for cp in range(0x80, 0x30000):
        ch = chr(cp)
        if 0xD800 <= cp < 0xE000:
            continue
        d = unicodedata.decomposition(ch)
        if not d or d[0] == "<":
            continue
        if unicodedata.normalize("NFC", ch) != ch:
            no.append(cp)
        elif " " in d:
            maybe.add(int(d.split()[1], 16))
    maybe |= {*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)}
    return _ranges(sorted({*no, *maybe}))


@functools.cache
def _marks() -> str:
    """A Java character class of all marks that have a place in the canonical order."""
    return _ranges([cp for cp in range(0x300, 0x20000) if unicodedata.combining(chr(cp))])


def _python(java: str) -> str:
    return re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", java)


#: Ends of lines and pages, which come out as line ends.
_BREAKS = "\x0b\x0c\x85\u2028\u2029"


@functools.cache
def _gone() -> frozenset[str]:
    """Characters that a word can't hold: spaces, controls and what is not there to see."""
    other = [*map(chr, (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0)), *map(chr, range(0x180B, 0x180F)), *map(chr, range(0xFE00, 0xFE10))]
    return frozenset([*other, *(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) in ("Cf", "Zs", "Zl", "Zp", "Cc"))])


@functools.cache
def _python_unstable() -> re.Pattern[str]:
    cls = _python(unstable_class())
    inv = "".join(f"\\U{ord(c):08x}" for c in sorted(_gone()))
    return re.compile(f"[{cls}{_COMPATIBLE}]+|(?P<gone>[{inv}]+)|(?P<apo>[{re.escape(APOSTROPHES)}])|(?P<hyp>[{re.escape(HYPHENS)}])")


@functools.cache
def _changed(keep_space: bool) -> tuple[dict[str, str], list[int]]:
    """What is replaced and by what, and what is normalised; plain spaces and line ends that are kept are in neither."""
    by: dict[str, str] = {}
    norm = []
    for c in map(chr, range(sys.maxunicode + 1)):
        m = _python_unstable().match(c)
        if m is None or keep_space and c in " \n\r\t":
            continue
        if c in _gone():
            by[c] = "" if not keep_space else " " if unicodedata.category(c) == "Zs" else "\n" if c in _BREAKS else ""
        elif m["apo"] or m["hyp"]:
            by[c] = "'" if m["apo"] else "-"
        else:
            norm.append(ord(c))
    return by, norm


@functools.cache
def _passes(keep_space: bool) -> tuple[re.Pattern[str], dict[str, str], re.Pattern[str]]:
    """The two passes over a text. Each begins with one class, which a search runs through fastest."""
    by, norm = _changed(keep_space)
    replaced, unstable, marks = _python(_ranges(sorted(map(ord, by)))), _python(_ranges(norm)), _python(_marks())
    # Two marks side by side may be in the wrong order, though each is stable by itself.
    return re.compile(f"[{replaced}]"), by, re.compile(f"[{unstable}][{unstable}]*|[{marks}][{marks}]+")


@functools.cache
def odd_class() -> str:
    """A Java character class of all characters that ``spliced`` may change in a text whose white space is kept."""
    by, norm = _changed(True)
    return _ranges(sorted({*map(ord, by), *norm}))


def spliced(text: str, keep_space: bool = False) -> str:
    """``text`` in canonical form: unstable segments normalised with the character they lean on, the rest unchanged."""
    replaced, by, pattern = _passes(keep_space)
    # What is not there to see goes first: it may stand between a letter and its accent.
    text = replaced.sub(lambda m: by[m[0]], text)
    out, last = [], 0
    for m in pattern.finditer(text):
        a, z = m.start(), m.end()
        while a > last and (unicodedata.combining(text[a]) or a == m.start()):
            a -= 1
        while z < len(text) and unicodedata.combining(text[z]):
            z += 1
        if z <= last:
            continue
        seg = "".join(unicodedata.normalize("NFKC", c) if _compatible(c) else c for c in text[a:z])
        out += [text[last:a], unicodedata.normalize("NFC", seg)]
        last = z
    return "".join([*out, text[last:]])


def _compatible(c: str) -> bool:
    cp = ord(c)
    return 0xFF01 <= cp <= 0xFFEE or 0xFB00 <= cp <= 0xFDFF or 0xFE70 <= cp <= 0xFEFC or cp in (0x132, 0x133, 0x17F, 0x149) or 0x1C4 <= cp <= 0x1CC or 0x1F1 <= cp <= 0x1F3


@functools.cache
def _tables(script: str) -> tuple[dict[str, str], dict[str, str]]:
    """What looks like a letter of ``script``: always, and within a word of it."""
    strict: dict[str, str] = {}
    loose: dict[str, str] = {}
    if script == "latin":
        for own in TO_LATIN_STRICT.values():
            strict |= own
        for own in TO_LATIN_LOOSE.values():
            loose |= own
    elif script in TO_LATIN_STRICT:
        strict = {v: k for k, v in TO_LATIN_STRICT[script].items()}
        loose = {v: k for k, v in TO_LATIN_LOOSE[script].items() if v not in strict}
    return strict, strict | {k: v for k, v in loose.items() if k not in strict}


@functools.cache
def _script_of(ch: str) -> str | None:
    for name, cls in SCRIPTS.items():
        if re.match(f"[{cls}]", ch):
            return name
    return "other" if unicodedata.category(ch)[0] == "L" else None


def plain_word(word: str, script: str | None) -> str:
    """``word`` in the plain form of a text in ``script``."""
    w = spliced(word)
    if script not in ("latin", "cyrillic", "greek", "armenian") or w.isascii() and script == "latin":
        return w
    strict, loose = _tables(script)
    parts = unicodedata.normalize("NFD", w)
    letters = [c for c in parts if _script_of(c)]
    foreign = [c for c in letters if _script_of(c) != script]
    if not foreign:
        return w
    table = loose if len(foreign) < len(letters) else strict if all(c in strict for c in foreign) else None
    if not table or not any(c in table for c in foreign):
        return w
    return unicodedata.normalize("NFC", "".join(table.get(c, c) if _script_of(c) not in (None, script) else c for c in parts))


def main_script(text: Column) -> Column:
    """The script a text is in: 'latin' unless other letters outnumber Latin ones, then the one most of them are from.

    A text without letters counts as Latin, null gives null. Letters alone are counted, so digits and marks decide nothing.
    The passes over a text end with the first script that has more than half of the other letters.
    """
    def which(rest: Column) -> Column:
        latin = F.length(F.regexp_replace(text, f"[^{SCRIPTS['latin']}]+", ""))
        # Where a stretch of the text has more Latin letters already than the whole has others, the rest can only add to them.
        some = F.length(F.regexp_replace(F.substring(text, F.lit(1), F.length(rest) * 20 + 1000), "[^A-Za-z]+", ""))
        count = {n: F.length(F.regexp_replace(rest, f"[^{c}]+", "")) for n, c in SCRIPTS.items() if n != "latin"}
        most = F.array_max(F.array(*(F.struct(n.alias("n"), F.lit(s).alias("s")) for s, n in count.items())))["s"]
        out = F.when(text.isNull(), None).when(F.length(rest) == 0, "latin").when(some >= F.length(rest), "latin").when(latin >= F.length(rest), "latin")
        for s in ("ideographic", "cyrillic", "arabic", "devanagari", "greek", "ethiopic", "armenian", "hangul", "hebrew", "thai", "georgian"):
            out = out.when(count[s] * 2 > F.length(rest), s)
        return out.otherwise(most)

    return let(F.regexp_replace(text, "[\\x{0}-\\x{24f}\\x{2000}-\\x{206f}\\x{3000}-\\x{303f}\\x{ff00}-\\x{ff65}]+", ""), which)


#: Blocks of letters and marks that words are usually made of.
_USUAL = [(0x20, 0x17F), (0x370, 0x3FF), (0x400, 0x45F), (0x531, 0x586), (0x5D0, 0x5EA), (0x621, 0x6D3), (0x900, 0x97F), (0xE01, 0xE5B), (0x1200, 0x135A), (0x3041, 0x30FC), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3)]


@functools.cache
def _settled() -> str:
    """A Java character class of the usual letters that are stable in any text, whatever stands beside them."""
    return _ranges([cp for a, z in _USUAL for cp in range(a, z + 1) if not _python_unstable().match(chr(cp))])


@functools.cache
def _usual_marks() -> str:
    """A Java character class of the marks among the usual letters, which are stable one by one but not in any order."""
    return _ranges([cp for a, z in _USUAL for cp in range(a, z + 1) if unicodedata.combining(chr(cp))])


@functools.cache
def _other_marks() -> str:
    """A Java character class of all other marks that have a place in the canonical order."""
    return _ranges([cp for cp in range(0x300, 0x20000) if unicodedata.combining(chr(cp)) and not any(a <= cp <= z for a, z in _USUAL)])


def suspect(word: Column) -> Column:
    """The quick check: whether ``word`` may differ from its plain form, whatever the script around it.

    Words of ASCII letters alone are told first; they can only be look-alikes as a whole.
    """
    alike = "".join({*"".join("".join(d) for d in TO_LATIN_STRICT.values()), *"".join("".join(d.values()) for d in TO_LATIN_STRICT.values())})
    latin, other = SCRIPTS["latin"], SCRIPTS["cyrillic"] + SCRIPTS["greek"] + SCRIPTS["armenian"]
    whole = word.rlike(f"^[{''.join(sorted(alike))}\\P{{L}}]+$") & word.rlike("\\p{L}")
    mixed = word.rlike(f"[{latin}]") & word.rlike(f"[{other}]")
    ascii_alike = "".join(sorted(c for c in alike if c.isascii()))
    odd = word.rlike("[`\\x{0}-\\x{20}\\x{7f}]")
    return F.when(word.rlike("[^\\x{0}-\\x{7e}]"), word.rlike(f"[^{_settled()}]|[{_usual_marks()}]{{2}}") | mixed | whole).otherwise(word.rlike(f"^[{ascii_alike}'-]+$") | odd)


@F.pandas_udf(StringType())
def _plain(words: pd.Series, scripts: pd.Series) -> pd.Series:
    known: dict[tuple[str, str | None], str] = {}
    out = []
    for key in zip(words, scripts, strict=True):
        if key not in known:
            known[key] = plain_word(*key)
        out.append(known[key])
    return pd.Series(out, dtype="object")


def plain_tokens(tokens: DataFrame, texts: DataFrame, word: str, record: str, position: str, text: str, salt: int = 16) -> DataFrame:
    """``record, position, clean``: each token whose word is not in plain form, with the form it should have.

    The script is that of most letters of the record's text; a record without text (or missing from ``texts``) has
    none, and then only look-alike letters stay as they are. A null word is left out; a word of nothing but invisible
    characters becomes empty; repeated rows come out once; an empty table gives no rows; other columns are ignored.
    The quick check runs in the scan, only suspects meet the scripts, by record and a salt of the position, so that a
    record with a third of all tokens is spread over ``salt`` times as many tasks.
    """
    odd = tokens.where(F.col(word).isNotNull() & suspect(F.col(word))).select(F.col(record).alias("r"), F.col(position).alias("p"), F.col(word).alias("w"), F.pmod(F.hash(position), F.lit(salt)).alias("s"))
    scripts = texts.select(F.col(record).alias("r"), main_script(F.col(text)).alias("script")).where("script is not null").withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    both = odd.join(scripts, ["r", "s"], "left").select("r", "p", "w", _plain("w", "script").alias("clean"))
    return both.where("w != clean").select(F.col("r").alias(record), F.col("p").alias(position), "clean").distinct()


@functools.cache
def _alike(script: str | None) -> re.Pattern[str] | None:
    """Characters that may change in a text in ``script``: look-alikes of its letters, with or without accents."""
    if script not in ("latin", "cyrillic", "greek", "armenian"):
        return None
    table = _tables(script)[1]
    return re.compile("[" + "".join(re.escape(c) for c in map(chr, range(0x41, 0x2000)) if any(d in table for d in unicodedata.normalize("NFD", c))) + "]")


def plain_text(text: str, script: str | None) -> str:
    """``text`` in canonical form, white space kept as spaces and line ends, each of its words in plain form.

    Words are those of the tokeniser; only stretches between white space that hold a look-alike are divided into words.
    """
    text = spliced(text, keep_space=True)
    alike = _alike(script)
    if alike is None:
        return text
    out, last = [], 0
    for m in alike.finditer(text):
        if m.start() < last:
            continue
        a, z = m.span()
        while a > last and not text[a - 1].isspace():
            a -= 1
        while z < len(text) and not text[z].isspace():
            z += 1
        out.append(text[last:a])
        last = a
        for _, b, e in tokenise(text[a:z], a):
            out += [text[last:b], plain_word(text[b:e], script)]
            last = e
        out.append(text[last:z])
        last = z
    return "".join([*out, text[last:]])


@F.pandas_udf(StringType())
def canonical(texts: pd.Series, scripts: pd.Series) -> pd.Series:
    """Whole texts in plain form, each in its script; null stays null."""
    return pd.Series([None if t is None else plain_text(t, s) for t, s in zip(texts, scripts, strict=True)], dtype="object")


@functools.cache
def stable_class() -> str:
    """A Java character class of what stays as it is in any text: usual letters, white space and marks of writing.

    It leaves out all that ``spliced`` may change, and the letters that may pass for those of another script. It is made
    of few ranges that begin with the most frequent characters, as a search asks one after another.
    """
    by, norm = _changed(True)
    changed = {*map(ord, by), *norm}
    kept = [*(x for x in _USUAL if x[0] not in (0x370, 0x400, 0x531)), (0x9, 0xA), (0xD, 0xD), (0x2013, 0x2027), (0x2030, 0x203E), (0x3001, 0x3030), (0xFF0C, 0xFF0C)]
    return _ranges(sorted(cp for a, z in kept for cp in range(a, z + 1) if cp not in changed))


def canonical_texts(df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``text`` in plain form, look-alikes in the script of most letters of the text; a text that passes the
    quick check (nothing but stable characters, no two marks side by side) never leaves the JVM. Null stays null."""
    t = F.col(text)
    odd = F.when(t.rlike(f"[^{stable_class()}]|[{_usual_marks()}]{{2}}"), t)
    return df.withColumn(text, F.coalesce(canonical(odd, main_script(odd)), t))

"""Sentence units of texts in many languages and scripts, as Spark expressions.

Points that end nothing (in decimals and addresses, after initials, abbreviations and ordinals, between pairs of letters)
are masked one for one by a private-use character; a second private-use character is put behind every end of a sentence
that the script's marks show; the pieces between are the sentences. As masks keep the length, offsets hold for the
unmasked text. A script that has no marks of its own (Thai, Lao, Khmer) is divided by paragraphs alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quireframe.functions.arrays import cut_at

MASK, CUT = "", ""
#: Words before a name, which a point never ends a sentence after.
TITLES = "Gov Sen Rep Pres Supt Atty Gens Adm Cmdr Mt Ft Sig Sigg Dott Avv Ing Egr Gent Sres Sras Exmo Exma Dhr Mevr Mej Ing Pani Pan Mgr Bp Fr Mr Mrs Ms Messrs Mme Mmes Mlle Mgr MM Mr Lieut Lt Capt Col Gen Maj Sgt Cpl Dr Drs Dra Prof Rev Hon Esq St Ste Sr Sra Srta Hr Hrn Fr Frl Hrsg Dña г гр гг проф акад св им тов Δρ κ κα κος κκ αγ Αγ डॉ श्री د أ"
#: Words before a number, which a point never ends a sentence after.
BEFORE_NUMBERS = "Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec janv févr juil déc ene abr ago dic genn febbr янв февр авг сент окт нояб дек p pp vol vols ch chap fig figs no No Nos nr Nr n nº art sec cap caps pág págs núm t Bd Bde Kap Abb Anm S Z т стр гл рис п ч № σελ αρ κεφ τ ص ج"
#: Words that end a name of a firm, which go on unless a word that begins sentences follows.
FIRMS = "Inc Corp Ltd Co Bros Cie Cía Ges Jr Sr"
#: Words that begin sentences and no name; after a pair of initials or a firm they show that a sentence ended.
STARTERS = "The This That These Those There Then They He She It We But And When While After Before If As At In On For To So Yet No Not His Her Their Its Our My What Who Why How Where Now Der Die Das Er Sie Es Wir Und Aber Le La Les Il Elle Ils Elles Nous Mais Et El Los Las Ella Ellos Pero Y"
#: Words that always go on.
GO_ON = "e.g i.e viz cf vs approx env bzw z.B z. B d.h d. h d. i u.a p.ej p. ej c.-à-d p. ex p.ex напр т. е т.е т. н π.χ δηλ βλ"
#: Pairs of letters with a point after each.
PAIRS = ["zB", "dh", "di", "ua", "uä", "pej", "pex", "тд", "те", "тп", "тн", "иг", "πχ", "κλπ", "sa"]
#: Months before which a number with a point is a day.
MONTHS = "Januar Jänner Februar März April Mai Juni Juli August September Oktober November Dezember"
#: Verbs by which a clause in a script without case reports the quotation before it.
REPORTS = ["と", "说道", "问道", "喊道", "答道", "叫道", "说", "問道", "कहा", "पूछा", "बोला", "बोली", "चिल्लाया", "قال", "قالت", "سأل", "سألت", "صاح", "أجاب", "هتف", "አለ", "ጠየቀ", "መለሰ"]

_SPACES = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0                　"
_W = f"[{_SPACES}​-‍⁠﻿­]"
_OPEN = "[\"'“”‘’«»„‚(\\[「『（《¿¡—–-]"
_MARK = ".!?…।॥؟۔։።፧‼⁇⁈⁉"
_CLOSE = "\"'”’“»›)\\]」』​-‍⁠﻿"
_FAR, _FAR_CLOSE = "。！？｡", "”’」』）》〉\"​-‍⁠﻿"


def _either(words: str) -> str:
    each = [w for w in words.replace("z. B", "z.~B").replace("d. h", "d.~h").replace("d. i", "d.~i").replace("p. ej", "p.~ej").replace("p. ex", "p.~ex").replace("т. е", "т.~е").replace("т. н", "т.~н").split()]
    return "|".join(w.replace(".", "\\.").replace("~", _W) for w in sorted({*each}, key=lambda w: (-len(w), w)))


#: A point after one of these, where what follows would otherwise let it end a sentence. The point itself comes first
#: in the pattern, so that text without points is passed over quickly.
_NO_LETTER = "(?<![\\p{L}\\p{M}\\p{N}])"
_STARTS = f"{_W}++(?:{'|'.join(sorted(set(STARTERS.split())))})(?![\\p{{L}}\\p{{M}}'’.-])"
_ALONG = "[\\p{L}\\p{N}_/%&=#@~-]"
_MASKED = (
    # decimals and addresses: a point with letters or digits on either side
    f"\\.(?:(?<={_ALONG}\\.)(?={_ALONG})(?<!\\p{{Lo}}\\.)(?!\\p{{Lo}})"
    f"|(?<={_NO_LETTER}(?:{_either(TITLES)}|{_either(GO_ON)})\\.)(?={_W}*+{_OPEN}*+[\\p{{Lu}}\\p{{Lo}}\\p{{N}}])"
    f"|(?<={_NO_LETTER}(?:{_either(FIRMS)})\\.)(?={_W}*+{_OPEN}*+[\\p{{Lu}}\\p{{Lo}}\\p{{N}}])(?!{_STARTS})"
    f"|(?<={_NO_LETTER}[\\p{{Lu}}&&[^IЯ]]\\.)(?={_W}*+{_OPEN}*+[\\p{{Lu}}\\p{{Lo}}\\p{{N}}])(?!(?<=\\p{{Lu}}[.{MASK}]\\p{{Lu}}\\.){_STARTS})"
    f"|(?<={_NO_LETTER}(?:{_either(BEFORE_NUMBERS)})\\.)(?={_W}*+\\p{{N}})"
    f"|(?<={_NO_LETTER}(?:{'|'.join(x[0] for x in PAIRS)})\\.)(?={_W}*+(?:{'|'.join(x[1:] for x in PAIRS)})\\.)"
    f"|(?<={_NO_LETTER}\\p{{Nd}}{{1,2}}\\.)(?={_W}*+(?:{'|'.join(MONTHS.split())})(?![\\p{{L}}\\p{{M}}])))"
)
#: Where a sentence ends although text follows.
_END = (
    f"((?:[{_MARK}]|፡፡|[;\\x{{37e}}](?<=[\\x{{370}}-\\x{{3ff}}\\x{{1f00}}-\\x{{1fff}}]\\p{{L}}{{0,3}}[;\\x{{37e}}]))(?:[   ]?[{_MARK}])*+(?:[   ]?»|[{_CLOSE}])*+)"
    f"(?={_W}++(?!(?<=[\"'”’»]{_W}{{1,4}})(?:{'|'.join(REPORTS)})(?![\\p{{L}}\\p{{M}}]))(?:{_OPEN}|{_W})*+[\\p{{Lu}}\\p{{Lt}}\\p{{Lo}}\\p{{N}}])"
    f"|([{_FAR}]++[{_FAR_CLOSE}]*+)(?!{_W}*+(?:[{_FAR}{_FAR_CLOSE}、，,]|\\p{{Ll}}|$))(?!(?<=[”’」』])(?:{'|'.join(REPORTS)}))"
)
_ZERO = "[​-‍⁠﻿­]*"
_ALIKE = {"C": "СϹＣ", "H": "НΗＨ", "A": "АΑＡ", "P": "РΡＰ", "T": "ТΤＴ", "E": "ЕΕＥ", "R": "Ｒ"}
_HEADING = f"^{_W}*" + _ZERO.join(f"[{c}{_ALIKE[c]}]" for c in "CHAPTER") + f"{_ZERO}{_W}+\\p{{Nd}}"


def _clean(text: Column) -> Column:
    """Private-use characters of the text's own can't be told from ours; they are replaced one for one."""
    return F.when(text.contains(MASK) | text.contains(CUT), F.translate(text, MASK + CUT, "")).otherwise(text)


def blocks(text: Column) -> Column:
    """The parts of ``text`` between blank lines, each with the white space after it, as structs ``text, start``."""
    return cut_at(F.regexp_replace(_clean(text), f"(\n[{_SPACES}]*\n[{_SPACES}]*)(?=[^{_SPACES}])", f"$1{CUT}"), CUT)


def sentences_of(text: Column) -> Column:
    """The sentences of one paragraph as structs ``text, start``, still with masks and outer white space."""
    masked = F.regexp_replace(text, _MASKED, MASK)
    return cut_at(F.regexp_replace(masked, _END, f"$1$2{CUT}"), CUT)


def sentences(df: DataFrame, record: str, text: str, first_block: bool = False) -> DataFrame:
    """``record, s_start, s_end, sentence``: the sentence units of every text, offsets in code points, half open.

    The first block (title and author) is left out unless ``first_block``; heading blocks (``CHAPTER`` and a number)
    hold none. A blank line ends a sentence, a line break does not. Null, empty and blank texts have no sentences;
    repeated rows give their sentences repeatedly; other columns are ignored. A text is handled block by block, so
    its length matters only for finding the blank lines.
    """
    parts = df.where(F.col(text).isNotNull()).select(F.col(record).alias("r"), F.posexplode(blocks(F.col(text))).alias("i", "b"))
    head = F.col("b.text")
    skipped = head.rlike(_HEADING) if first_block else (F.col("i") == 0) | head.rlike(_HEADING)
    each = parts.where(~skipped).select("r", F.col("b.start").alias("at"), F.explode(sentences_of(F.col("b.text"))).alias("s"))
    kept = F.rtrim(F.col("s.text"), F.lit(_SPACES))
    lead = F.length(kept) - F.length(F.ltrim(kept, F.lit(_SPACES)))
    begin = F.col("at") + F.col("s.start")
    return each.select(F.col("r").alias(record), (begin + lead).alias("s_start"), (begin + F.length(kept)).alias("s_end"), F.replace(F.ltrim(kept, F.lit(_SPACES)), F.lit(MASK), F.lit(".")).alias("sentence")).where("s_end > s_start")

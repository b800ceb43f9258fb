"""Values in many notations: years, counts, dates, truth values, lengths and plain text, as Column expressions.

Each function gives null for a text that does not denote exactly one value: blanks, stand-ins, ranges, guesses,
impossible dates and days that could be read in two ways.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = "[\\s\\p{Z}\\x{feff}\\x{200b}]"
#: What stands for a missing text.
STAND_INS = ["n/a", "n.a.", "unknown", "none", "null", "nil", "tbd", "missing", "not known", "not available", "not given", "no data"]
NUMBER_WORDS = ["one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen", "twenty"]
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
_WIDE = "０１２３４５６７８９．，－／：＋"
_MONTH = "|".join(f"{m[:3]}(?:{m[3:]})?" if m[3:] else m for m in MONTHS).replace("sep(?:tember)?", "sept?(?:ember)?")


def tidy(v: Column) -> Column:
    """Digits of ordinary width, no outer white space, inner runs of it as one space."""
    v = F.translate(v, _WIDE, "0123456789.,-/:+")
    return F.regexp_replace(F.regexp_replace(v, f"^{SPACE}+|{SPACE}+$", ""), f"{SPACE}+", " ")


def _group(v: Column, pattern: str, i: int) -> Column:
    return F.nullif(F.regexp_extract(v, pattern, i), F.lit(""))


def roman(v: Column) -> Column:
    """The number a well-formed Roman numeral stands for."""
    v = F.upper(v)
    ok = v.rlike("^(?=.)M{0,4}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$")
    many = lambda s: (F.length(v) - F.length(F.replace(v, F.lit(s), F.lit("")))) / len(s)
    total = reduce(lambda a, b: a + b, [many(c) * n for c, n in zip("MDCLXVI", (1000, 500, 100, 50, 10, 5, 1), strict=True)])
    less = reduce(lambda a, b: a + b, [many(c) * n for c, n in (("CM", 200), ("CD", 200), ("XC", 20), ("XL", 20), ("IX", 2), ("IV", 2))])
    return F.when(ok, (total - less).cast("int"))


def year(v: Column) -> Column:
    v = tidy(v)
    digits = _group(v, r"(?i)^(?:(?:first )?(?:published|printed|issued)(?: in)?|in|anno|a\.? ?d\.?|copyright|©)?:? ?[\[(]?(\d{4})[\])]?(?: ?a\.? ?d\.?)?\.?$", 1)
    number = roman(F.regexp_replace(v, r"\.$", ""))
    return F.coalesce(digits.cast("int"), F.when(number >= 1000, number))


def count(v: Column) -> Column:
    v = F.lower(tidy(v))
    core = _group(v, r"^(?:in )?([a-z]+|\d{1,4})(?:[.,]0+)?(?: ?(?:v|vols?|volumes?|bde?|tomes?|parts?)\.?)?$", 1)
    words = reduce(lambda a, b: a.when(core == b[1], b[0]), enumerate(NUMBER_WORDS, 1), F.when(F.lit(False), 0))
    n = F.coalesce(F.when(core.rlike("^\\d+$"), core).cast("int"), words, roman(core))
    return F.when(n > 0, n)


def day(v: Column) -> Column:
    """A date; 3/4 is no day as it has two readings, 13/4 is one."""
    v = F.lower(tidy(v))
    iso = r"^(\d{4})(?:-(\d{1,2})-(\d{1,2})|/(\d{1,2})/(\d{1,2})|\.(\d{1,2})\.(\d{1,2})|(\d{2})(\d{2}))(?:[t ]\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?z?)?$"
    dots, cuts = r"^(\d{1,2})\. ?(\d{1,2})\. ?(\d{4})$", r"^(\d{1,2})[/-](\d{1,2})[/-](\d{4})$"
    first = rf"^(\d{{1,2}})(?:st|nd|rd|th)?\.? (?:of )?({_MONTH})\.?,? (\d{{4}})$"
    last = rf"^({_MONTH})\.? (\d{{1,2}})(?:st|nd|rd|th)?,? (\d{{4}})$"

    def made(y: Column, m: Column, d: Column) -> Column:
        return F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")).try_cast("date")

    def month(name: Column) -> Column:
        return ((F.instr(F.lit("".join(m[:3] for m in MONTHS)), F.left(name, F.lit(3))) + 2) / 3).cast("int").cast("string")

    a, b = _group(v, cuts, 1), _group(v, cuts, 2)
    big_a, big_b = a.cast("int") > 12, b.cast("int") > 12
    return (
        F.when(v.rlike(iso), made(_group(v, iso, 1), F.coalesce(*(_group(v, iso, i) for i in (2, 4, 6, 8))), F.coalesce(*(_group(v, iso, i) for i in (3, 5, 7, 9)))))
        .when(v.rlike(dots), made(_group(v, dots, 3), _group(v, dots, 2), _group(v, dots, 1)))
        .when(v.rlike(cuts), F.when(big_a | (a.cast("int") == b.cast("int")), made(_group(v, cuts, 3), b, a)).when(big_b, made(_group(v, cuts, 3), a, b)))
        .when(v.rlike(first), made(_group(v, first, 3), month(_group(v, first, 2)), _group(v, first, 1)))
        .when(v.rlike(last), made(_group(v, last, 3), month(_group(v, last, 1)), _group(v, last, 2)))
    )


def truth(v: Column) -> Column:
    v = F.regexp_replace(F.lower(tidy(v)), r"\.$", "")
    return F.when(v.isin("true", "t", "yes", "y", "1"), True).when(v.isin("false", "f", "no", "n", "0"), False)


def centimetres(v: Column) -> Column:
    """A length in centimetres, with one digit after the point."""
    v = F.lower(tidy(v))
    form = r"^\+?(\d{1,4}(?:[.,]\d+)?) ?([½¼¾]?) ?(cm|mm|m|centimet(?:re|er)s?|millimet(?:re|er)s?|met(?:re|er)s?)?\.?$"
    n = F.translate(_group(v, form, 1), ",", ".").cast("decimal(12,6)")
    part = F.when(_group(v, form, 2) == "½", 0.5).when(_group(v, form, 2) == "¼", 0.25).when(_group(v, form, 2) == "¾", 0.75).otherwise(0).cast("decimal(4,2)")
    unit = F.regexp_extract(v, form, 3)
    cm = F.when(unit.startswith("mm") | unit.startswith("milli"), (n + part) / 10).when(unit.rlike("^met|^m$"), (n + part) * 100).otherwise(n + part)
    return F.round(cm, 1).cast("decimal(8,1)")


def text(v: Column) -> Column:
    t = F.regexp_replace(F.regexp_replace(v, f"^{SPACE}+|{SPACE}+$", ""), f"{SPACE}+", " ")
    return F.when(t.rlike(r"[\p{L}\p{N}]") & ~F.lower(t).isin(*STAND_INS), t)

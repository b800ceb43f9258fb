from __future__ import annotations

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from quireframe.llm.plain import canonical_texts, main_script, odd_class, plain_tokens, plain_word, spliced, stable_class, suspect

CASES = [
    ("latin", "ｂｒｅａｍ", "bream"), ("latin", "nоt", "not"), ("latin", "hаνe", "have"), ("latin", "i﻿n", "in"), ("latin", "corp\xadus", "corpus"), ("latin", "but\xa0", "but"), ("latin", "saiﬂi", "saifli"), ("latin", "caiﬆ", "caist"), ("latin", "nél", "nél"), ("latin", "don’t", "don't"), ("latin", "ʼtis", "'tis"),
    ("latin", "it＇s", "it's"), ("latin", "wead‑cir", "wead-cir"), ("latin", "a－b", "a-b"), ("latin", "ѕо", "so"), ("latin", "тюсть", "тюсть"), ("latin", "φικιδι", "φικιδι"), ("latin", "e​́t", "ét"), ("latin", "œuvre", "œuvre"), ("latin", "３.５", "3.5"), ("latin", "plain", "plain"), ("latin", "naïve", "naïve"),
    ("cyrillic", "oн", "он"), ("cyrillic", "тюcть", "тюсть"), ("cyrillic", "chapter", "chapter"), ("cyrillic", "c", "с"), ("cyrillic", "vëс", "vёс"), ("cyrillic", "тыфой", "тыфой"), ("greek", "τoυ", "του"), ("greek", "vα", "να"), ("greek", "κήδε", "κήδε"), ("greek", "μόvoς", "μόνος"),
    ("ideographic", "ﾀｳｱｷ", "タウアキ"), ("ideographic", "ｶﾞ", "ガ"), ("ideographic", "a", "a"), ("arabic", "أن", "أن"), ("devanagari", "क‍े", "के"), ("armenian", "վարoմ", "վարօմ"), (None, "ｎо", "nо"),
]


@pytest.mark.parametrize("script, word, clean", CASES)
def test_words(script, word, clean):
    assert plain_word(word, script) == clean
    assert plain_word(clean, script) == clean  # plain stays plain


def test_quick_check_misses_nothing(spark):
    df = spark.createDataFrame([(w, w != c) for _, w, c in CASES], "w string, odd boolean")
    assert df.where("odd").where(~suspect(F.col("w"))).count() == 0
    assert df.where(F.col("w").isin("plain", "naïve", "œuvre", "тюсть", "chapter", "3.5")).where(suspect(F.col("w"))).count() == 0


def test_splice_equals_whole_normalisation():
    r = random.Random(3)
    marks = ["́", "̈", "̣", "̧", "़", "ٔ"]
    for _ in range(3000):
        s = "".join(r.choice(["a", "e", "o", "é", "ẹ", "क", "ا", "x", " ", "한", "ᄒ", "ᅡ", "ᆫ", *marks]) for _ in range(r.randrange(1, 12)))
        assert spliced(s, keep_space=True) == unicodedata.normalize("NFC", s), ascii(s)


def test_order_of_any_marks():
    """Each mark may be stable by itself and still stand in the wrong place."""
    r = random.Random(5)
    marks = [c for c in map(chr, range(0x300, 0x1F000)) if unicodedata.combining(c)]
    for _ in range(20_000):
        s = "".join(r.choice(["a", "x", "ב", "ا", "क", "ㄱ", *r.choices(marks, k=6)]) for _ in range(r.randrange(1, 9)))
        assert spliced(s, keep_space=True) == unicodedata.normalize("NFC", s), ascii(s)
    for s in ("\u0628\u0651\u064e", "\u05e9\u05bc\u05b0", "a\u0315\u0316"):
        assert spliced(s) == unicodedata.normalize("NFC", s) != s


def test_quick_check_and_normaliser_agree_on_every_character():
    odd = re.compile(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", f"[{odd_class()}]"))
    stable = re.compile(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", f"[{stable_class()}]"))
    for c in map(chr, [*range(0xD800), *range(0xE000, 0x110000)]):
        if spliced(f"x{c}y", keep_space=True) != f"x{c}y":
            assert odd.match(c) and not stable.match(c), hex(ord(c))
    assert all(stable.match(c) for c in "aZ9 é\n—“字かक한ا") and not any(stable.match(c) for c in "о’ο\xa0ﬁＡ")


def test_order_of_marks_is_seen_by_the_checks(spark):
    texts = ["كبّ\u064eر", "\u05e9\u05bc\u05b0ל", "xa\u0315\u0316y"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string")
    assert df.where(suspect(F.col("t"))).count() == 3
    assert {r["id"]: r["t"] for r in canonical_texts(df, "t").collect()} == {i: unicodedata.normalize("NFC", t) for i, t in enumerate(texts)}


def test_tokens_by_book(spark, rows):
    books = spark.createDataFrame([(1, "the plain text of an English book with фраза", 0), (2, "русский текст книги, chapter 1", 0), (3, None, 0), (4, "", 0)], "book_id long, content string, s int")
    data = [(1, 0, "nоt", 9), (1, 0, "nоt", 9), (1, 4, "so", 9), (1, 7, None, 9), (1, 9, "​", 9), (2, 0, "oн", 9), (2, 3, "с", 9), (2, 5, "c", 9), (2, 7, "a", 9), (3, 0, "ｘ", 9), (3, 2, "nоt", 9), (4, 0, "nоt", 9), (9, 0, "ｘ", 9), (1, None, "ﬁn", 9), (None, 1, "ﬁn", 9)]
    tokens = spark.createDataFrame(data, "book_id long, tok_start int, ttype string, clean int")
    got = rows(plain_tokens(tokens, books, "ttype", "book_id", "tok_start", "content"))
    assert got == sorted([(1, 0, "not"), (1, 9, ""), (2, 0, "он"), (2, 5, "с"), (2, 7, "а"), (3, 0, "x"), (4, 0, "not"), (9, 0, "x"), (1, None, "fin"), (None, 1, "fin")], key=repr)
    assert rows(plain_tokens(tokens.limit(0), books, "ttype", "book_id", "tok_start", "content")) == []


def test_scripts(spark):
    texts = {"abc ф": "latin", "": "latin", "привет abc": "cyrillic", "見る読む": "ideographic", "Τι είναι 12": "greek", "كتاب": "arabic", "के घैन": "devanagari", "123 ...": "latin", "12 345 678 901 да": "cyrillic", "የኪፈሉት": "ethiopic", "վարամ": "armenian"}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r["t"]: r["s"] for r in df.select("t", main_script(F.col("t")).alias("s")).collect()} == texts


def test_contents(spark, rows):
    long = "ordinary words " * 50_000 + "ｅｎｄ"
    df = spark.createDataFrame([(1, "A b\n“ｃ” é​", "k"), (2, None, "k"), (3, "plain", "k"), (4, long, "k")], "id long, t string, odd string")
    assert {r["id"]: r["t"] for r in canonical_texts(df, "t").collect()} == {1: "A b\n“c” é", 2: None, 3: "plain", 4: long[:-3] + "end"}


def test_contents_fold_look_alikes(spark):
    texts = {1: ("I сould nοt see thе тюсть, «hаνe» nό\xadt-а.", "I could not see the тюсть, «have» nót-a."), 2: ("тюcть и oн, фраза, фраза, chapter c", "тюсть и он, фраза, фраза, chapter с"), 3: ("τoυ μόvoς, φικιδι", "του μόνος, φικιδι"), 4: ("見る а nοt", "見る а nοt"), 5: (None, None), 6: ("plain only", "plain only")}
    df = spark.createDataFrame([(i, a) for i, (a, _) in texts.items()], "id long, t string")
    assert {r["id"]: r["t"] for r in canonical_texts(df, "t").collect()} == {i: z for i, (_, z) in texts.items()}


def test_contents_quick_check_misses_nothing(spark):
    odd = "\u2000\u2002\u2009\u200a\u3000\u061c\u2066\u2069\u180e\x0b\x0c\x85\u2028\u034f\ufe0f\u3164\u00ad\u200b\u00a0"
    texts = [f"a{c}b" for c in odd]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = {r["id"]: r["t"] for r in canonical_texts(df, "t").collect()}
    assert got == {i: spliced(t, keep_space=True) for i, t in enumerate(texts)}
    assert [got[i] for i in range(13)] == ["a b"] * 5 + ["ab"] * 4 + ["a\nb"] * 4 and [got[i] for i in range(13, 19)] == ["ab"] * 5 + ["a b"]
    assert spliced("a\u2000b") == "ab"

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quireframe.functions.arrays import cut_at, prefix_sums
from quireframe.llm.sentences import sentences

SCHEMA = "book_id long, content string"


def split(spark, text, **kwargs):
    df = spark.createDataFrame([(1, text)], SCHEMA)
    return [text[r["s_start"] : r["s_end"]] for r in sentences(df, "book_id", "content", **kwargs).orderBy("s_start").collect()]


@pytest.mark.parametrize(
    "parts",
    [
        ["“Is it?” asked Mr. Dob at last.", "He did not say.", "‘So it is!’ said she, ‘and more.’"],
        ["“One two.", "Three four?”", "“Five six,” said X, “seven.”", "(Not so.)", "It went on... and on.", "Then it… stopped!", "So"],
        ["On p. 12 of vol. 3, fig. 4 shows 3.14 of it.", "No. 5 came to St. Ann at 5 p.m. and left, viz. by boat, etc.", "Dr. J. R. Hall saw e.g. Lieut. Dob?!", "A word. . . was said."],
        ["« Est-il là ? » demanda M. Dob, « ou non ? »", "Oui, etc.", "C.-à-d. rien. »"],
        ["„Ist es so?“ fragte Hr. Dob am 20. Mai.", "Er kam z. B. nicht, d. h. nie.", "„Gut.“", "Nr. 5 auf S. 7."],
        ["¿Es así?", "«¡Sí!» dijo la Sra. Dob en la pág. 7.", "Luego p. ej. nada."],
        ["«Так ли?» спросил г. Доб.", "Да, т. е. нет, см. стр. 5.", "«И всё.»"],
        ["«Είναι;» ρώτησε ο κ. Ντομπ.", "Ναι, π.χ. εδώ.", "Όχι!"],
        ["«هل هو؟» سأل دوب.", "لا شيء 3.5 هنا.", "«نعم!»"],
        ["“क्या यह है?” पूछा डोब।", "हाँ, 2.5 है।", "“ठीक।”"],
        ["«Այո,» ասաց Դոբ։", "Ոչ։"],
        ["«አዎ፣» አለ ዶብ።", "እሺ።", "«ነው።»"],
    ],
)
def test_scripts_with_spaces(spark, parts):
    assert split(spark, " ".join(parts), first_block=True) == parts
    assert split(spark, "\n".join(parts), first_block=True) == parts


@pytest.mark.parametrize("parts", [["「これは？」と森は言った。", "「はい。", "それで！」", "「次」の3.5の本。", "終"], ["“是吗，”问道丘，“不是。”", "他走了！", "“书？”", "“好。", "再见。”", "完"]])
def test_scripts_without_spaces(spark, parts):
    assert split(spark, "".join(parts), first_block=True) == parts


def test_blocks(spark):
    text = "Title\nAuthor\n\nCHAPTER 1. A head. With points.\n\n\nA line\nends not here. Another\n \nwithout mark\n\nCHAPTER 12\n\nChapter talk. ＣＨＡＰＴＥＲ\n"
    assert split(spark, text) == ["A line\nends not here.", "Another", "without mark", "Chapter talk.", "ＣＨＡＰＴＥＲ"]


def test_edges(spark, rows):
    long = "Head\n\n" + "A word or two. " * 40_000
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, " \n\n ", "x"), (4, "T\n\nOne.  Two", "x"), (4, "T\n\nOne.  Two", "x"), (5, long, "x"), (6, "T\n\n\ue000Aha.  Bob\ue001.", "x")], SCHEMA + ", at string")
    got = sentences(df, "book_id", "content")
    assert rows(got.where("book_id < 5").select("book_id", "s_start", "s_end")) == [(4, 3, 7), (4, 3, 7), (4, 9, 12), (4, 9, 12)]
    assert got.where("book_id = 5").count() == 40_000 and got.where("book_id = 5").agg(F.max("s_end")).first()[0] == len(long) - 1
    assert got.where("book_id = 6").count() == 2
    assert sentences(df.limit(0), "book_id", "content").count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 65, 200])
def test_prefix_sums(spark, n):
    data = [(i * 7) % 11 for i in range(n)]
    df = spark.createDataFrame([(data,)], "a array<int>")
    assert df.select(prefix_sums(F.col("a"))).first()[0] == [sum(data[:i]) for i in range(n)]


def test_cut_at(spark):
    df = spark.createDataFrame([("ab|cde||f",)], "t string")
    assert [tuple(x) for x in df.select(cut_at(F.col("t"), "\\|")).first()[0]] == [("ab", 0), ("cde", 2), ("", 5), ("f", 5)]


@pytest.mark.parametrize(
    "text, units",
    [
        ("See Inc. Magazine and Corp. Law, Jan. 5, 1850. It went on.", ["See Inc. Magazine and Corp. Law, Jan. 5, 1850.", "It went on."]),
        ("She met Gov. Smith and Sen. Jones in Washington D.C. They spoke.", ["She met Gov. Smith and Sen. Jones in Washington D.C.", "They spoke."]),
        ("Il Sig. Rossi arrivò. Parlò poi.", ["Il Sig. Rossi arrivò.", "Parlò poi."]),
        ("He works at Acme Inc. The firm is old. J. The Elder came.", ["He works at Acme Inc.", "The firm is old.", "J. The Elder came."]),
        ("It grew by 3.5 Percent. See https://example.org/A.B?Q=1.2 Now. Or www.x.org. Then go.", ["It grew by 3.5 Percent.", "See https://example.org/A.B?Q=1.2 Now.", "Or www.x.org.", "Then go."]),
    ],
)
def test_abbreviations_decimals_and_addresses(spark, text, units):
    df = spark.createDataFrame([(1, text)], "id long, t string")
    got = sentences(df, "id", "t", first_block=True).orderBy("s_start").collect()
    assert [r["sentence"] for r in got] == units and [text[r["s_start"] : r["s_end"]] for r in got] == units

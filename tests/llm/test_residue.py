from __future__ import annotations

from pathlib import Path

import pytest

from quireframe.llm.residue import ideas, line_kind, residue, words_of

PROSE = "The lamp was lit and the house was quiet. Nobody came to the door that night."
SCHEMA = "id long, t string, h string, a string"


def reasons(spark, *texts):
    df = spark.createDataFrame([(i, t, "h", None) for i, t in enumerate(texts)], SCHEMA)
    got = {r["id"]: r["reasons"] for r in residue(df, "id", "t", "h").collect()}
    return [got.get(i, []) for i in range(len(texts))]


@pytest.mark.parametrize(
    "reason, texts",
    [
        ("slot", ["Dear {{ first_name }},", "Written by ${title}, X press.", "by #{book.author}", "<%= edition-year %>", "{% block title %}", "<<AUTHOR>>", "&lt;author_name&gt;", "@@TITLE@@", "Title: __AUTHOR_NAME__", "%(page)s", "a %corpus.description% b", "[[author]]", "[AUTHOR_NAME HERE]", "<INSERT TITLE>", "Summary of {title} ({year})"]),
        ("filler", ["[TEXT GOES HERE]", "TODO: your text here", "Chapter text to follow. Chapter text to follow.", "Synopsis\n\n(blah blah)", "Lorem ipsum dolor amet tempus velit.", "xxx xxx xxx", "TK TK TK", "asdf asdf", "________ ________ ________", ". . . . . . . . . . . . . . .", "<此处填写正文>", "[ここに本文を入力]", "(здесь будет текст)", "Texto de ejemplo. Texto de ejemplo.", "(texte à compléter)", "Hier Text einfügen."]),
        ("error", ["404 Not Found\n-----\nnginx/1.2", "HTTP/1.1 503 Service Unavailable\nContent-Type: text/html", "ERROR 500: INTERNAL SERVER ERROR", "Gone\n\nThe requested URL /a could not be served.", "Fehler 404 – Seite nicht gefunden", "Erreur 404 : page introuvable", "Ошибка 404. Страница не найдена", "404 ページが見つかりません", "404 页面不存在", "خطأ 404: الصفحة غير موجودة", "त्रुटि 404: पृष्ठ नहीं मिला", "Access denied. Your request was blocked. Reference #1.2", "Too many requests. Retry after 29 seconds.", "Your session has expired. Please sign in again to read on.", "Oops! We can’t find that chapter. (404)", "Traceback (most recent call last):\n  File \"x.py\", line 1, in load", "Fatal error: Call to undefined function x() in /a.php on line 3", "Database connection failed: could not connect to server at x", "Sorry, the book you asked for is no longer here. Go back or try a search.", "Application error: a server-side exception has occurred (digest 1)."]),
        ("stand_in", ["Coming soon...", "Under construction", "Próximamente!", "Diese Seite ist in Arbeit (x)", "Page en construction.", "Страница в разработке.", "準備中です...", "No description available", "This page intentionally left blank.", "Content pending!"]),
        ("notice", ["Please enable JavaScript to view this page.", "<noscript>JavaScript is required to read this text.</noscript>", "Your browser does not support scripts. Turn them on and reload.", "This reader needs cookies and scripts; they seem to be switched off.", "Bitte aktivieren Sie JavaScript, um den Text zu lesen.", "Veuillez activer JavaScript pour lire ce texte.", "Active JavaScript para ver el contenido.", "Включите JavaScript, чтобы читать дальше.", "请启用 JavaScript 后继续阅读。", "JavaScriptを有効にしてください。", "يرجى تفعيل جافا سكريبت لعرض الصفحة", "Checking your browser before opening the shelf… scripts must be allowed."]),
    ],
)
def test_cases(spark, reason, texts):
    whole = reasons(spark, *texts)
    assert [reason in r for r in whole] == [True] * len(texts), [t for t, r in zip(texts, whole) if reason not in r]
    within = [t for t in texts if "\n" not in t and not t.startswith((". .", "__"))]
    got = reasons(spark, *(f"{PROSE}\n\n{t}\n\n{PROSE}" for t in within))
    assert all(reason in r for r in got), [t for t, r in zip(within, got) if reason not in r]


def test_what_only_speaks_of_it(spark):
    texts = [
        "Typesetters used lorem ipsum as filler for two centuries, and this lecture traces how.", "double braces such as “{{ name }}” are explained as slots", "The BibTeX entry has title = {{The Motom of Thime}}, and the braces keep", "The price was $5 {about a week’s wages}, and the ledger says 100% of it was paid",
        "“Not found,” said the clerk, and closed the catalogue.", "The server of the inn was unavailable, having gone to the fair.", "visitors were asked to enable JavaScript, which few did.", "a note in brackets [see the preface] marks each use.", "She wrote coming soon on the cover.", "why a page once answered 404 and how the shelf was put back", PROSE,
        "an internal error of the clerk kept it so for years, access denied or not.", "He was soon coming home.", "5% of 10% is little", "x __ y",
    ]
    assert reasons(spark, *texts) == [[]] * len(texts)


HERE = Path(__file__).parent


def test_paraphrases_in_many_languages():
    """594 everyday messages that no detector has as such; prose that only speaks of such things is none."""
    known = ideas()
    kind = lambda x: line_kind(x) if known.leads(words_of(x)) else None
    lines = (HERE / "residue_paraphrases.txt").read_text().lower().splitlines()
    assert len(lines) > 590 and sum(kind(x) not in (None, "weak") for x in lines) >= 0.85 * len(lines)
    assert [x for x in (HERE / "residue_prose.txt").read_text().lower().splitlines() if kind(x) not in (None, "weak")] == []


def test_one_response_under_many_titles(spark):
    """A response in words of no language, under titles and addresses it shares no word with, on several hosts."""
    soft = "Zorp {} quib nar flem"
    data = [(i, f"Page of Tome{i}\n\n{soft.format(i)}", f"h{i % 4}", None) for i in range(12)]
    data += [(100 + i, soft.format(i), f"h{i % 4}", f"/books/alice-{i}") for i in range(12)]  # the slug stands for a title
    data += [(200 + i, f"A quib\n\n{soft.format(i)} once", f"h{i % 4}", None) for i in range(12)]  # the title is about it
    data += [(300 + i, f"Title {i}\n\nPlom quint {i} tars nop", "h1", None) for i in range(12)]  # one host
    data += [(400 + i, "Same title\n\nVor tull has nim", f"h{i % 4}", None) for i in range(12)]  # copies
    data += [(500 + i, f"Tome{i}\n\n" + " ".join(f"w{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(300)), f"h{i % 4}", None) for i in range(12)]  # it says more than its titles show
    df = spark.createDataFrame(data, SCHEMA)
    got = {r["id"]: r["reasons"] for r in residue(df, "id", "t", "h", "a").collect()}
    assert got == {i: ["repeated"] for i in [*range(12), *range(100, 112)]}


def test_one_idea_needs_evidence(spark):
    data = [(i, "Forbidden", f"h{i}", None) for i in range(3)] + [(10, "Denied", "h", None), (11, PROSE + "\nForbidden\n" + PROSE * 3, "h9", None)]
    got = {r["id"] for r in residue(spark.createDataFrame(data, SCHEMA), "id", "t", "h", "a").collect()}
    assert got == {0, 1, 2}


def test_edges(spark, rows):
    df = spark.createDataFrame([(1, None, None, None, 1, "q"), (2, "", "h", None, 1, "q"), (3, "  \n", "h", None, 1, "q"), (4, "TBD", None, None, 1, "q"), (4, "TBD", None, None, 1, "q"), (5, PROSE * 20_000 + "\n{{x}}\n", "h", None, 1, "q")], SCHEMA + ", d int, reasons string")
    assert rows(residue(df, "id", "t", "h", "a")) == [(4, ["filler"]), (5, ["slot"])] and rows(residue(df.limit(0), "id", "t")) == []

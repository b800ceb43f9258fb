from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from quireframe.api import CLUSTER_LENGTHS, Corpus, facets, region_preview
from quireframe.errors import UserError
from quireframe.operators.importing import annotate
from tests.test_corpus import EDITH, HERRING


@pytest.fixture(scope="module")
def corpus(spark):
    t = annotate(spark.createDataFrame([(1, "edith", EDITH), (2, "herring", HERRING)], "book_id long, name string, content string"))
    t["corpus"] = spark.createDataFrame([(1, "both", "Both", bytearray(b"x"), 0), (2, "one", "One", None, 1)], "corpus_id int, name string, title string, carousel_image binary, ordering int")
    t["corpus_book"] = spark.createDataFrame([(1, 1), (1, 2), (2, 2)], "corpus_id int, book_id long")
    return Corpus(t, aliases={"old": ["corpus:one"]})


def test_concordance(corpus):
    a = corpus.concordance(["the crow"], ["corpus:both"], contextsize=1, metadata=["book_titles", "word_count_all"])
    rows = a.data.orderBy("start").collect()
    assert [("".join(r["left"]["parts"]), "".join(r["node"]["parts"]), "".join(r["right"]["parts"])) for r in rows] == [("Storm\n\n", "The Crow", " had"), ("saw ", "the Crow", "")]
    assert {r["title"] for r in a.footer["book_titles"].collect()} == {"Edith", "Herring"} and a.footer["word_count_all"].count() == 2
    out = json.loads("".join(a.json()))
    assert len(out["data"]) == 2 and len(out["book_titles"]) == 2
    assert corpus.drill_down("the crow", ["old"]).data.count() == 2 and corpus.concordance(["the crow"], [1]).data.count() == 0
    for bad in (lambda: corpus.concordance(["x"], []), lambda: corpus.concordance([], [1]), lambda: corpus.concordance(["x"], [1], ["all", "quote"])):
        with pytest.raises(UserError):
            bad()
    with pytest.raises(KeyError):
        corpus.concordance(["x"], [1], ["nonsense"])


def test_lists(corpus):
    a = corpus.cluster(2, ["old"])
    assert {r["ngram"] for r in a.data.collect()} == {"the crow"} and "less than 2" in a.header["info"]["message"]
    assert corpus.cluster(1, ["corpus:both"]).data.where("freq < 5").count() == 0
    k = corpus.keyword(1, 1.0, ["corpus:one"], [1])
    assert "info" in k.header and k.data.columns[0] == "type"
    assert "warn" in corpus.keyword(1, 0.05, ["corpus:one"], [1], refsubset=["longsus"]).header
    assert corpus.swapped_keyword(1, 1.0, [1], ["corpus:one"]).data.collect() == k.data.collect()
    f = facets(corpus.cluster(1, [2], cutoff=1).data).first()
    assert f["type"] == "the" and 0 < f["percentage"] < 100 and 7 in CLUSTER_LENGTHS


def test_rest(corpus):
    assert corpus.count(["corpus:both"]).data.columns == ["book_id", "all", "shortsus", "longsus", "nonquote", "quote"]
    assert corpus.subset(["corpus:both"], ["quote"]).data.count() == 5
    t = corpus.text(["edith"], ["chapter.title"])
    assert t.header["content"] == EDITH and t.data.count() == 2
    with pytest.raises(UserError):
        corpus.text(["corpus:both"])
    b = corpus.book_with_regions("herring", content=True, regions=True).first()
    assert b["content"] == HERRING and [tuple(r) for r in b["regions"][302]] == [(17, 33, 1)]
    assert corpus.book_with_regions(1).first()[:] == (1, "edith")
    assert [r["corpus_name"] for r in corpus.corpora().collect()] == ["both", "one"] and corpus.authors().count() == 2
    assert [r["book_count"] for r in corpus.headlines().collect()] == [2, 1] and bytes(corpus.image(["both"]).first()[0]) == b"x"
    assert "\x1b[" in region_preview(EDITH, ["quote"])
    derived = Corpus({"book": corpus.book, "token": corpus.token, "text_region": corpus.regions, "corpus": corpus.corpus_table, "corpus_book": corpus.corpus_book, "book_metadata": corpus.meta})
    assert derived.headlines().collect() == corpus.headlines().collect()
    assert corpus.token.agg(F.count("*")).first()[0] > 0


def test_views_have_limits():
    from quireframe.api import check_view

    check_view(3, 0.01, (-5, 5), 10)
    for wrong in ({"clusterlength": 8}, {"pvalue": 0.5}, {"span": (-6, 0)}, {"span": (2, 1)}, {"node_span": 11}):
        with pytest.raises(UserError):
            check_view(**wrong)


def test_a_session_notes_and_remembers(corpus):
    from quireframe.api import Session

    s = Session(corpus)
    first = s.ask("count", [1])
    assert s.ask("count", [1]) is first and len(s.noted) == 1 and "book_id" in s.noted[0][1]
    s.ask("count", [2])
    assert s.ask("count", [1]) is not first and len(s.noted) == 3
    assert s.warm([("count", {"corpora": [1]}), ("count", {"corpora": [1, 2]})]) == [1, 2]


def test_some_books_of_a_store(spark, corpus, tmp_path):
    from quireframe.operators.importing import load, save

    tables = {"book": corpus.book, "token": corpus.token}
    save(tables, str(tmp_path), buckets=8)
    one = load(spark, str(tmp_path), [2])
    assert [r[0] for r in one["token"].select("book_id").distinct().collect()] == [2]
    plan = one["token"]._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert load(spark, str(tmp_path))["token"].count() == corpus.token.count()

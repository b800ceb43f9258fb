"""The public queries over a store, with their defaults, errors and what goes before and after the rows."""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireframe.errors import UserError
from quireframe.functions.breaks import ENGLISH
from quireframe.operators import clusters, concordance, corpora, footers, importing, keyness, kwic, store, subsets
from quireframe.operators.tagging import tag
from quireframe.schema import rclass_id, subset_id
from quireframe.session import table
from quireframe.sources import render
from quireframe.sources.export import stream_json

#: What a reader is offered: lengths of clusters, levels of significance, distances of context words.
CLUSTER_LENGTHS, P_VALUES, SPAN, NODE_SPAN = range(1, 8), (0.05, 0.01, 0.001, 0.0001), range(-5, 6), range(1, 11)
#: Arguments that views of a concordance and of a subset begin with.
CONCORDANCE_VIEW = {"contextsize": 10, "metadata": ("book_titles", "chapter_start", "word_count_all")}
SUBSET_VIEW = {"contextsize": 5, "metadata": ("book_titles", "chapter_start", "word_count_all")}


@dataclass
class Answer:
    """Rows, with what is said before them and the tables about their books."""

    data: DataFrame
    header: dict = field(default_factory=dict)
    footer: dict[str, DataFrame] = field(default_factory=dict)

    def json(self):
        """The answer in chunks of one JSON object; footers as lists of rows."""
        return stream_json(self.data, self.header, {k: [list(r) for r in v.collect()] for k, v in self.footer.items()})


class Corpus:
    """Queries over the tables book, token, text_region, corpus, corpus_book, book_metadata and, if there, book_word_count."""

    def __init__(self, tables: Mapping[str, DataFrame], aliases: Mapping[str, Sequence[str]] | None = None) -> None:
        self.book, self.corpus_table, self.corpus_book, self.meta = (tables[t] for t in ("book", "corpus", "corpus_book", "book_metadata"))
        self.token, self.regions = tables["token"], store.regions(tables["text_region"])
        self._counts, self.aliases = tables.get("book_word_count"), aliases or {}

    @classmethod
    def at(cls, spark: SparkSession, folder: str, **kwargs) -> Corpus:
        """Over a folder with a parquet file or folder for each table."""
        return cls({t: table(spark, folder, t) for t in ("book", "token", "text_region", "corpus", "corpus_book", "book_metadata")}, **kwargs)

    @classmethod
    def of_store(cls, spark: SparkSession, path: str, **kwargs) -> Corpus:
        """Over a store that ``importing.save`` and ``put_corpora`` have written."""
        return cls(importing.load(spark, path) | {t: spark.read.parquet(f"{path}/{t}") for t in ("corpus", "corpus_book")}, **kwargs)

    @classmethod
    def of_books(cls, spark: SparkSession, path: str, book_ids: Sequence[int], **kwargs) -> Corpus:
        """Over some books of a store, for which only the buckets they are in are read."""
        return cls(importing.load(spark, path, book_ids) | {t: spark.read.parquet(f"{path}/{t}") for t in ("corpus", "corpus_book")}, **kwargs)

    @property
    def counts(self) -> DataFrame:
        if self._counts is None:
            self._counts = store.word_counts(self.token, self.regions, [301, 501, 502, 503, 504]).groupBy("book_id", "rclass_id", "rvalue").agg(F.sum("word_count").alias("word_count"))
        return self._counts

    def ids(self, specs: Sequence[str | int]) -> DataFrame:
        return corpora.resolve(specs, self.corpus_table, self.corpus_book, self.book, self.meta, self.aliases)

    def _within(self, specs: Sequence[str | int]) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Ids, tokens and regions of the books asked for."""
        ids = self.ids(specs)
        return ids, self.token.join(ids, "book_id", "left_semi"), self.regions.join(ids, "book_id", "left_semi")

    def _footer(self, items: Sequence[str], ids: DataFrame) -> dict[str, DataFrame]:
        of = lambda df: df.join(ids, "book_id", "left_semi")
        return footers.footer(items, of(self.regions), of(self.counts), of(self.meta)) if items else {}

    def concordance(self, q: Sequence[str], corpora: Sequence[str | int] = ("corpus:dickens",), subset: Sequence[str] = ("all",), contextsize: int = 0, metadata: Sequence[str] = ()) -> Answer:
        """Lines with their windows of text; each query's one after another."""
        ids, tok, _ = self._within(corpora)
        if len(subset) != 1:
            raise UserError("You must supply exactly one subset")
        lines = concordance.concordance(tok, q, [subset_id(subset[0])], contextsize)
        return Answer(concordance.with_text(lines, self.book), footer=self._footer(metadata, ids))

    def subset(self, corpora: Sequence[str | int] = ("corpus:dickens",), subset: Sequence[str] = ("all",), contextsize: int = 0, metadata: Sequence[str] = ()) -> Answer:
        """Every region of the subsets with its windows of text."""
        ids, tok, reg = self._within(corpora)
        lines = subsets.listing(tok, reg, [subset_id(s) for s in subset], contextsize)
        return Answer(concordance.with_text(lines, self.book), footer=self._footer(metadata, ids))

    def cluster(self, clusterlength: int = 1, corpora: Sequence[str | int] = ("corpus:dickens",), subset: Sequence[str] = ("all",), cutoff: int | None = None) -> Answer:
        """The word list from the cutoff on; the header tells how many are below."""
        ids, tok, _ = self._within(corpora)
        if cutoff is None:
            cutoff = 5 if ids.limit(2).count() > 1 else 2
        words = clusters.word_list(tok, [subset_id(s) for s in subset], clusterlength)
        below = words.where(F.col("freq") < cutoff).count()
        header = {"info": {"message": f"{below} clusters with a frequency less than {cutoff} are not shown"}} if below else {}
        return Answer(words.where(F.col("freq") >= cutoff), header)

    def keyword(self, clusterlength: int, pvalue: float, corpora: Sequence[str | int], refcorpora: Sequence[str | int], subset: Sequence[str] = ("all",), refsubset: Sequence[str] = ("all",), limit: int | None = 3000) -> Answer:
        """Key words of a corpus and subset against a reference; a warning instead of rows if either is empty."""
        lists = [clusters.word_list(self._within(c)[1], [subset_id(s) for s in sub], clusterlength) for c, sub in ((corpora, subset), (refcorpora, refsubset))]
        totals = [w.agg(F.sum("freq")).first()[0] or 0 for w in lists]
        rows = keyness.keywords(*lists, p_value=pvalue, limit=limit)
        if not all(totals):
            return Answer(rows, {"warn": {"message": f"The {'target' if not totals[0] else 'reference'} has no clusters of this length"}})
        return Answer(rows, {"info": {"message": f"The target has {totals[0]} clusters, the reference {totals[1]}"}})

    def swapped_keyword(self, clusterlength: int, pvalue: float, corpora: Sequence[str | int], refcorpora: Sequence[str | int], subset: Sequence[str] = ("all",), refsubset: Sequence[str] = ("all",), limit: int | None = 3000) -> Answer:
        """``keyword`` with target and reference exchanged."""
        return self.keyword(clusterlength, pvalue, refcorpora, corpora, refsubset, subset, limit)

    def count(self, corpora: Sequence[str | int], subset: Sequence[str] = ("all", "shortsus", "longsus", "nonquote", "quote"), metadata: Sequence[str] = ()) -> Answer:
        """Tokens of every book by subset, in the order asked for."""
        ids, tok, _ = self._within(corpora)
        return Answer(subsets.counts(tok, {s: subset_id(s) for s in subset}), footer=self._footer(metadata, ids))

    def text(self, corpora: Sequence[str | int], regions: Sequence[str] = ()) -> Answer:
        """One book's content in the header and its regions of the named classes as rows."""
        ids = [r["book_id"] for r in self.ids(corpora).limit(2).collect()]
        if len(ids) != 1:
            raise UserError("Ask for exactly one book")
        content = self.book.where(F.col("book_id") == ids[0]).first()["content"]
        reg = self.regions.where((F.col("book_id") == ids[0]) & F.col("rclass_id").isin([rclass_id(r) for r in regions]))
        return Answer(reg.select("rclass_id", "r_start", "r_end", "rvalue").orderBy("r_start", "r_end"), {"content": content})

    def book_with_regions(self, spec: str | int, content: bool = False, regions: bool = False) -> DataFrame:
        """One book by id or name, perhaps with its content and its regions by class in the order of their ranges."""
        one = self.book.where(F.col("book_id") == spec if isinstance(spec, int) else F.col("name") == spec)
        out = one.select("book_id", "name", *(["content"] if content else []))
        if regions:
            each = F.array_sort(F.collect_list(F.struct("r_start", "r_end", "rvalue")))
            by_class = self.regions.groupBy("book_id", "rclass_id").agg(each.alias("r")).groupBy("book_id").agg(F.map_from_entries(F.collect_list(F.struct("rclass_id", "r"))).alias("regions"))
            out = out.join(by_class, "book_id", "left")
        return out

    def corpora(self) -> DataFrame:
        """Corpora with their books, as a reader chooses from them."""
        return corpora.nested_listing(corpora.listing(self.corpus_table, self.corpus_book, self.book, self.meta))

    def authors(self) -> DataFrame:
        return corpora.books_per_author(corpora.listing(self.corpus_table, self.corpus_book, self.book, self.meta))

    def headlines(self) -> DataFrame:
        return corpora.headlines(self.corpus_table, self.corpus_book, self.counts).orderBy("ordering", "title")

    def image(self, corpora_: Sequence[str]) -> DataFrame:
        if len(corpora_) != 1:
            raise UserError("Ask for exactly one corpus")
        return corpora.image(self.corpus_table, corpora_[0])

    def drill_down(self, ngram: str, corpora: Sequence[str | int], subset: Sequence[str] = ("all",), **kwargs) -> Answer:
        """The concordance behind a row of clusters or key words."""
        return self.concordance([ngram], corpora, subset, **(CONCORDANCE_VIEW | kwargs))


def check_view(clusterlength: int | None = None, pvalue: float | None = None, span: tuple[int, int] | None = None, node_span: int | None = None) -> None:
    """UserError where a reader asks for what the views don't offer."""
    if clusterlength is not None and clusterlength not in CLUSTER_LENGTHS:
        raise UserError(f"Clusters have {CLUSTER_LENGTHS[0]} to {CLUSTER_LENGTHS[-1]} words")
    if pvalue is not None and pvalue not in P_VALUES:
        raise UserError(f"Levels of significance are {', '.join(map(str, P_VALUES))}")
    if span is not None and (not {*span} <= {*SPAN} or span[0] > span[1]):
        raise UserError(f"Context words are looked for from {SPAN[0]} to {SPAN[-1]}")
    if node_span is not None and node_span not in NODE_SPAN:
        raise UserError(f"Of a node {NODE_SPAN[0]} to {NODE_SPAN[-1]} words are looked at")


class Session:
    """A reader's way with a corpus: what is asked is noted, and what was asked last is answered from memory."""

    def __init__(self, corpus: Corpus, remember: int = 1) -> None:
        self.corpus, self.remember = corpus, remember
        self.answers: dict[str, Answer | DataFrame] = {}
        self.noted: list[tuple[str, str]] = []

    def ask(self, query: str, *args, **kwargs) -> Answer | DataFrame:
        """The answer to a public query by name; asked again it is the one given before, if it is still remembered."""
        key = f"{query}{args!r}{sorted(kwargs.items())!r}"
        if key in self.answers:
            self.answers[key] = self.answers.pop(key)
            return self.answers[key]
        answer = getattr(self.corpus, query)(*args, **kwargs)
        rows = answer.data if isinstance(answer, Answer) else answer
        plan = rows._jdf.queryExecution().simpleString()
        self.noted.append((key, plan))
        logging.getLogger(__name__).info("%s\n%s", key, plan)
        self.answers[key] = answer
        while len(self.answers) > self.remember:
            del self.answers[next(iter(self.answers))]
        return answer

    def warm(self, requests: Sequence[tuple[str, dict]]) -> list[int]:
        """Asks all requests and keeps their rows in the cluster's memory; the numbers of rows."""
        self.remember = max(self.remember, len(requests))
        counts = []
        for query, kwargs in requests:
            answer = self.ask(query, **kwargs)
            counts.append((answer.data if isinstance(answer, Answer) else answer).cache().count())
        return counts


def region_preview(content: str, highlight: Sequence[str] | None = None, suppress: frozenset[str] = ENGLISH) -> str:
    """A text tagged and coloured for a terminal."""
    return render.ansi(content, tag(content, suppress=suppress), highlight)


def facets(words: DataFrame) -> DataFrame:
    """A word list by frequency with each type's share of all tokens in per cent."""
    total = words.agg(F.sum("freq").alias("n")).scalar()
    return words.select(F.col("ngram").alias("type"), F.col("freq").alias("count"), kwic.share(F.col("freq"), total).alias("percentage")).orderBy(F.desc("count"), "type")

"""The search engine as a Python interface: build, search, expand, suggest, evaluate."""

from __future__ import annotations

import html
import json
import time
from collections import OrderedDict
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import EngineConfig
from .functions.analysis import full_tokens, page_title, short_url, strip_markup, tokens
from .operators import autocomplete, evaluate, feedback, graph, logs, rank
from .operators.index import Index
from .plans.query import FULL, PLAIN, Analyzer, SearchRequest, query_tables
from .sources import corpus

#: Prefixes whose suggestions an engine keeps.
CACHED = 10_000


def mine(pages: DataFrame, log: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """``url, page_rank, views`` of every page that is no redirect."""
    nodes, edges = graph.build_graph(pages)
    ranks = graph.pagerank(nodes, edges, config.damping, config.pagerank_iterations).withColumnRenamed("node", "url")
    views = logs.view_counts(log, pages, graph.redirects(pages))
    return ranks.join(views, "url", "left").select("url", "page_rank", F.coalesce("views", F.lit(0)).alias("views"))


@dataclass
class SearchEngine:
    """Documents have ``doc_id, text`` and, for display, ``title, url``; signals ``doc_id, page_rank, views``.

    The configuration names the analyzer of documents and queries, the kind of
    index (phrases need one with positions: without, their words match as such) and
    the weight of documents in query likelihood.
    """

    spark: SparkSession
    index: Index
    signals: DataFrame | None = None
    log: DataFrame | None = None
    config: EngineConfig = EngineConfig()
    #: Suggestions by prefix and number; a fixed number of entries, the oldest go.
    known: OrderedDict = field(default_factory=OrderedDict)

    @classmethod
    def build(cls, docs: DataFrame, signals: DataFrame | None = None, log: DataFrame | None = None, config: EngineConfig = EngineConfig()) -> SearchEngine:
        return cls(docs.sparkSession, Index.build(docs, config.stopwords_n, full_tokens if config.analyzer == "full" else tokens), signals, log, config)

    @classmethod
    def from_pages(cls, pages: DataFrame, signals: DataFrame | None = None, log: DataFrame | None = None, config: EngineConfig = EngineConfig()) -> SearchEngine:
        """An engine over the visible text of pages ``doc_id, url, html``."""
        return cls.build(pages.select("doc_id", "url", page_title("html").alias("title"), strip_markup("html").alias("text"), "html"), signals, log, config)

    @classmethod
    def load(cls, spark: SparkSession, path: str, signals: DataFrame | None = None, log: DataFrame | None = None, config: EngineConfig = EngineConfig()) -> SearchEngine:
        return cls(spark, Index.load(spark, path, config.stopwords_n), signals, log, config)

    @property
    def analyzer(self) -> Analyzer:
        return FULL if self.config.analyzer == "full" else PLAIN

    def _how(self) -> dict:
        return {"positions": self.config.indexer_type not in ("fullscan", "inverted-doconly"), "mix": self.config.ql_lambda}

    def search(self, queries: list[tuple[int, str]], ranker: str = "cosine", k: int | None = None) -> DataFrame:
        """``query_id, rank, doc_id, score``; all queries in one job."""
        return rank.search(self.index, *query_tables(self.spark, queries, self.analyzer), ranker, k or self.config.results, self.signals, **self._how())

    def prf(self, queries: list[tuple[int, str]], ranker: str = "cosine", documents: int | None = None, terms: int | None = None) -> DataFrame:
        found = self.search(queries, ranker, documents or self.config.prf_documents)
        return feedback.expansion_terms(self.index, found, terms or self.config.prf_terms)

    def prf_lines(self, request: SearchRequest) -> str:
        """The terms of one query's expansion as lines ``term<tab>probability``."""
        rows = self.prf([(0, request.query)], request.ranker, request.results, request.terms).orderBy(F.desc("prob"), "term").collect()
        return "".join(f"{r['term']}\t{r['prob']}\n" for r in rows)

    def prf_search(self, queries: list[tuple[int, str]], ranker: str = "cosine", k: int | None = None) -> DataFrame:
        c = self.config
        return feedback.expanded_search(self.spark, self.index, queries, ranker, k or c.results, c.prf_terms, c.prf_min_probability, self.signals, self.analyzer, **self._how())

    def write_runs(self, queries: list[str], path: str, ranker: str = "cosine", expanded: bool = False) -> float:
        """Answers a list of queries, writes their result files and returns the mean milliseconds of a query."""
        began = time.time()
        numbered = list(enumerate(queries))
        found = (self.prf_search if expanded else self.search)(numbered, ranker)
        named = found.join(F.broadcast(self.spark.createDataFrame(numbered, "query_id int, query string")), "query_id")  # the caller's list
        corpus.write_runs(named.select("query", "rank", "doc_id"), path)
        return 1000 * (time.time() - began) / max(len(queries), 1)

    def clicked(self, requests: DataFrame, path: str) -> None:
        """Appends clicks to the click log; what a request lacks is noted as ``ERROR``."""
        corpus.append_clicks(logs.click_record(requests), path)

    def document(self, name: str, elsewhere: str = "https://en.wikipedia.org/wiki/") -> tuple[int, str]:
        """Status and stored page of a name, or a redirect to where its page is."""
        docs = self.index.documents
        row = docs.where(F.col("url") == name).select("html" if "html" in docs.columns else "text").first()
        return (200, row[0]) if row else (302, elsewhere + name)

    def instant(self, prefix: str) -> str:
        """Suggestions for what is being typed, as JSON with the milliseconds it took."""
        began = time.time()
        found = self.suggestions(prefix)
        return json.dumps({"time": round(1000 * (time.time() - began)), "results": found})

    def suggestions(self, prefix: str, k: int | None = None) -> list[str]:
        """The suggestions of a prefix, k at most, kept for the next time."""
        key = (prefix, k or self.config.suggestions)
        if key not in self.known:
            self.known[key] = [r["suggestion"] for r in self.suggest(*key).orderBy("rank").collect()]
            if len(self.known) > CACHED:
                self.known.popitem(last=False)
        return self.known[key]

    def suggestion_latency(self, queries: list[str], k: int = 500) -> float:
        """Mean milliseconds of a suggestion over a list of queries, each asked for anew."""
        began = time.time()
        for query in queries:
            self.suggest(query, k).collect()
        return 1000 * (time.time() - began) / max(len(queries), 1)

    def suggest(self, prefix: str, k: int | None = None) -> DataFrame:
        if self.log is None:
            raise ValueError("the engine has no query log")
        return autocomplete.suggest(self.log, prefix, k or self.config.suggestions)

    def evaluate(self, queries: list[tuple[int, str]], judged: DataFrame, ranker: str = "cosine", expanded: bool = False) -> DataFrame:
        """All figures per query; ``judged``: ``query, doc_id, gain`` with query ids."""
        run = self.prf_search(queries, ranker) if expanded else self.search(queries, ranker)
        return evaluate.report(run.withColumnRenamed("query_id", "query"), judged)

    def shown(self, results: DataFrame) -> DataFrame:
        """Results with what is displayed of their documents."""
        docs = self.index.documents
        text = lambda c: F.col(c) if c in docs.columns else F.lit(None).cast("string").alias(c)
        out = results.join(docs.select("doc_id", text("title"), text("url")), "doc_id", "left")
        if self.signals is not None:
            out = out.join(self.signals, "doc_id", "left")
        else:
            out = out.withColumns({"page_rank": F.lit(0.0), "views": F.lit(0)})
        return out.withColumn("short_url", short_url("url")).orderBy("query_id", "rank")

    def respond(self, request: SearchRequest) -> str:
        """One search as text, HTML or JSON; the results of one request fit the driver."""
        began = time.time()
        rows = self.shown(self.search([(0, request.query)], request.ranker, request.results)).collect()
        if request.format == "json":
            results = [{"id": r["doc_id"], "title": r["title"], "url": r["url"], "query": request.query} for r in rows]
            return json.dumps({"time": round(1000 * (time.time() - began)), "results": results})
        if request.format == "html":
            items = (f'<li><a href="{html.escape(str(r["url"]))}">{html.escape(str(r["title"]))}</a> <cite>{html.escape(str(r["short_url"]))}</cite></li>' for r in rows)
            return f"<ol>{''.join(items)}</ol>"
        return "".join(f"{r['doc_id']}\t{r['title']}\t{r['score']}\tPageRank: {r['page_rank']}\tNumViews: {r['views']}\n" for r in rows)

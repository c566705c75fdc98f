"""All registered queries and their SQL, by name.

The driver's tables stand in for a web corpus: documents for the corpus, the
``k`` of view and click events for articles and links, part names for a query
log, labels for judgements.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import analysis, codec
from ..operators import autocomplete, evaluate, feedback, graph, index, logs, rank, retrieve, stats
from .query import FULL, query_tables

#: The batch of searches that all retrieval queries answer.
QUERIES = [
    (1, "thble"),
    (2, "thing ering"),
    (3, "eriner thble thing"),
    (4, '"anea eriner"'),
    (5, '"anea eriner" thble'),
    (6, "the thing of ering"),
    (7, "thing thing thble"),
    (8, "the of and"),
    (9, "nosuchterm thing"),
    (10, 'ering "the thing'),
]
TITLE_QUERIES = [(1, "the"), (2, "of thing"), (3, "nosuchterm")]
BIGRAMS = [(1, "anea", "eriner"), (2, "of", "the"), (2, "the", "thing"), (3, "thble", None)]
SUGGEST = "red"
FIXED_HTML = [
    ("A", '<a href="B" title="x">B</a>\n<a href="C">C</a> and <a href="D">D</a>\n<a href="http://x.y/z">out</a>'),
    ("B", '<a href="C">C</a>\n<a href="D">D</a>\n<a href="#top">top</a>'),
    ("C", '<a href="A">A</a>'),
    ("D", '<a href="A">A</a>\n<a href="C">C</a>'),
    ("R1", '<meta http-equiv="refresh" content="0;url=R2">'),
    ("R2", '<meta http-equiv="refresh" content="0;url=A">'),
    ("X1", '<meta http-equiv="refresh" content="0;url=X2">'),
    ("X2", '<meta http-equiv="refresh" content="0;url=X1">'),
    # A redirect chain that is longer than any fixed number of hops one might follow.
    *((f"K{k}", f'<meta http-equiv="refresh" content="0;url={f"K{k + 1}" if k < 40 else "B"}">') for k in range(1, 41)),
    ("F", '<a href="K1">K1</a>'),
    ("E", '<a href="R1">R1</a>\n<a href="A">A</a>\n<a href="A">A</a>\n<a href="E">E</a>\n<a href="X1">X1</a>'),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


@lru_cache(maxsize=4)
def built(spark: SparkSession, sf_dir: str) -> index.Index:
    """The index of a corpus, built by the first query that needs it and kept in Spark's cache."""
    return index.Index.build(documents(spark, sf_dir))


@lru_cache(maxsize=2)
def built_full(spark: SparkSession, sf_dir: str) -> index.Index:
    """The same with the full analyzer."""
    return index.Index.build(documents(spark, sf_dir), analyze=analysis.full_tokens)


def asked(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return query_tables(spark, QUERIES)


def events_of(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").where(F.col("event_type") == kind)
    return rows.select("event_id", "ts", "user_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


def click_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and links of the click stream: from each click of a user to the next."""
    clicks = events_of(spark, sf_dir, "click")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    edges = clicks.select(F.col("k").alias("src"), F.lead("k").over(order).alias("dst")).where("dst IS NOT NULL")
    return clicks.select(F.col("k").alias("node")).distinct(), edges


def article_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = events_of(spark, sf_dir, "view").select(F.col("k").cast("string").alias("article"), F.lit("1").alias("views"))
    corpus = documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("url"))
    return logs.view_counts(log, corpus)


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, page_rank, views`` of the documents."""
    ranks = graph.pagerank(*click_graph(spark, sf_dir)).select(F.col("node").alias("doc_id"), "page_rank")
    return article_views(spark, sf_dir).select(F.col("url").cast("long").alias("doc_id"), "views").join(ranks, "doc_id", "left").select("doc_id", F.coalesce("page_rank", F.lit(0.0)).alias("page_rank"), "views")


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# Index

def corpus_stats(spark, d):
    ix = built(spark, d)
    return index.corpus_totals(ix.documents, ix.terms)


def term_stats(spark, d):
    return built(spark, d).terms


def postings_positional(spark, d):
    return index.positional_postings(analysis.tokens(documents(spark, d))).select("term", "doc_id", F.col("tf").cast("long").alias("tf"), F.array_join("positions", ",").alias("positions"))


def postings_doconly(spark, d):
    return index.document_postings(analysis.tokens(documents(spark, d)))


def forward_topk(spark, d):
    return index.forward_index(built(spark, d).tf, 5).withColumn("rank", F.col("rank").cast("long"))


def forward_no_stopwords(spark, d):
    ix = built(spark, d)
    return index.without_stop_words(ix.tf, ix.stops).select("doc_id", "term", "tf")


def stopwords_topn(spark, d):
    return built(spark, d).stops


def doc_norms(spark, d):
    return rounded(built(spark, d).stats, "norm2", digits=4)


def postings_delta_vbyte_size(spark, d):
    return codec.encoded_sizes(index.positional_postings(analysis.tokens(documents(spark, d))))


# Matching and ranking

def match_and(spark, d):
    return retrieve.match_all(built(spark, d), *asked(spark))


def match_or(spark, d):
    return retrieve.match_any(built(spark, d), asked(spark)[0])


def match_phrase(spark, d):
    return retrieve.phrase_matches(built(spark, d).toks, asked(spark)[1])


def match_phrase_doconly(spark, d):
    return retrieve.phrase_terms_matches(built(spark, d).tf, asked(spark)[1]).drop("starts")


def fullscan_title(spark, d):
    titles = documents(spark, d).select("doc_id", F.substring_index("text", "\n", 1).alias("title"))
    return rank.title_match(titles, query_tables(spark, TITLE_QUERIES)[0])


def _ranked(name: str, digits: int = 6) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark, d):
        more = {"signals": signals(spark, d)} if name in rank.WITH_SIGNALS else {}
        ix, (terms, phrases) = built(spark, d), asked(spark)
        scored = rank.ranker(name)(ix, terms, retrieve.match_all(ix, terms, phrases), **more)
        return rank.top_k(rounded(scored, "score", digits=digits)).withColumn("rank", F.col("rank").cast("long"))

    return run


def rank_favorite(spark, d):
    return rounded(rank.search(built(spark, d), *asked(spark), "favorite"), "score").withColumn("rank", F.col("rank").cast("long"))


def rank_batch(spark, d):
    return rounded(rank.batch(built(spark, d), *asked(spark), ["conjunctive", "numviews"], 5, signals(spark, d)), "score").withColumn("rank", F.col("rank").cast("long"))


def rank_cosine_full(spark, d):
    """Cosine with the full analyzer on both sides."""
    ix, (terms, phrases) = built_full(spark, d), query_tables(spark, QUERIES, FULL)
    return rank.top_k(rounded(rank.cosine(ix, terms, retrieve.match_all(ix, terms, phrases)), "score")).withColumn("rank", F.col("rank").cast("long"))


def match_phrase_full(spark, d):
    return retrieve.phrase_matches(built_full(spark, d).toks, query_tables(spark, QUERIES, FULL)[1])


def rank_plain_cosine(spark, d):
    return rank.top_k(rounded(rank.plain_cosine(built(spark, d), asked(spark)[0]), "score")).withColumn("rank", F.col("rank").cast("long"))


def rank_plain_ql(spark, d):
    return rank.top_k(rounded(rank.plain_likelihood(built(spark, d), asked(spark)[0]), "score")).withColumn("rank", F.col("rank").cast("long"))


def rank_combined(spark, d):
    """Cosine, likelihood, neighbouring words and views of every match in one sum."""
    ix, (terms, phrases) = built(spark, d), asked(spark)
    bigrams = spark.createDataFrame(BIGRAMS, "query_id int, first string, second string")
    found = rank.combined_rank(ix, terms, retrieve.match_all(ix, terms, phrases), bigrams, signals(spark, d))
    return rank.top_k(rounded(found, "score")).withColumn("rank", F.col("rank").cast("long"))


def rank_bigram(spark, d):
    bigrams = spark.createDataFrame(BIGRAMS, "query_id int, first string, second string")
    return rank.top_k(rank.bigram_rank(built(spark, d), bigrams)).withColumn("rank", F.col("rank").cast("long"))


# Feedback

def prf_terms(spark, d):
    ix, (terms, phrases) = built(spark, d), asked(spark)
    found = rank.top_k(rounded(rank.cosine(ix, terms, retrieve.match_all(ix, terms, phrases)), "score"))
    return rounded(feedback.expansion_terms(ix, found), "prob")


def prf_search(spark, d):
    return rounded(feedback.expanded_search(spark, built(spark, d), QUERIES), "score").withColumn("rank", F.col("rank").cast("long"))


def query_bhattacharyya(spark, d):
    return rounded(feedback.bhattacharyya(prf_terms(spark, d)), "similarity", digits=4)


# Graph and logs

def fixed_pages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FIXED_HTML, "url string, html string")


def all_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of the corpus, which have no redirects, and fixed ones that have."""
    return table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("url"), "html").unionByName(fixed_pages(spark))


def links_extracted(spark, d):
    pages = table(spark, d, "pages").select(F.col("page_id").cast("string").alias("url"), "html")
    found = graph.links(pages, graph.ANY_LINK).unionByName(graph.links(fixed_pages(spark)))
    return found.groupBy("url", "target").agg(F.count("*").alias("n"))


def redirect_closure(spark, d):
    return graph.close_redirects(graph.redirects(all_pages(spark, d)))


def pagerank_pages(spark, d):
    return rounded(graph.pagerank(*graph.build_graph(all_pages(spark, d))), "page_rank", digits=9)


def pagerank_2iter(spark, d):
    return rounded(graph.pagerank(*click_graph(spark, d)), "page_rank", digits=9)


def num_views(spark, d):
    return article_views(spark, d)


def click_counts(spark, d):
    clicks = events_of(spark, d, "click").select(F.col("user_id").cast("string").alias("session"), F.col("k").alias("doc_id"))
    return logs.click_counts(clicks)


# Statistics

def _ranks(spark, d) -> DataFrame:
    return graph.pagerank(*click_graph(spark, d)).select(F.col("node").alias("key"), F.round("page_rank", 9).alias("value"))


def _views(spark, d) -> DataFrame:
    return article_views(spark, d).select(F.col("url").cast("long").alias("key"), F.col("views").alias("value"))


def rank_avg_ties(spark, d):
    return stats.rank_with_ties(_views(spark, d))


def rank_tiebreak(spark, d):
    return stats.rank_without_ties(_views(spark, d)).withColumn("rank", F.col("rank").cast("long"))


def spearman(spark, d):
    return rounded(stats.spearman(_ranks(spark, d), _views(spark, d)), "rho")


def pagerank_histogram(spark, d):
    return rounded(stats.pagerank_histogram(_ranks(spark, d)), "percent")


def numviews_histogram(spark, d):
    return rounded(stats.views_histogram(_views(spark, d)), "percent")


# Autocomplete

def _log(spark, d) -> DataFrame:
    return table(spark, d, "part").select(analysis.clean_log_query("p_name").alias("query"), F.lit(1).cast("long").alias("cnt"))


def query_log_consolidated(spark, d):
    return autocomplete.consolidate(_log(spark, d))


def autocomplete_topk(spark, d):
    return autocomplete.suggest(autocomplete.consolidate(_log(spark, d)), SUGGEST).withColumn("rank", F.col("rank").cast("long"))


# Evaluation

def _judged(spark, d) -> tuple[DataFrame, DataFrame]:
    grade = F.when(F.col("quality") != 1, "Bad").when(F.col("toxic") == 1, "Fair").otherwise("Good")
    qrels = table(spark, d, "labels").select("doc_id", grade.alias("grade"))
    ids = spark.createDataFrame(QUERIES, "query int, text string").select("query")
    judged = evaluate.judgements(qrels.crossJoin(F.broadcast(ids)).select("query", "doc_id", "grade", F.lit(0).alias("line")))  # the fixed batch of queries
    ix, (terms, phrases) = built(spark, d), asked(spark)
    run = rank.top_k(rounded(rank.cosine(ix, terms, retrieve.match_all(ix, terms, phrases)), "score")).select(F.col("query_id").alias("query"), "rank", "doc_id")
    return run, judged


def _evaluated(figures: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark, d):
        out = figures(evaluate.judged_run(*_judged(spark, d)))
        return rounded(out, *(c for c in out.columns if c != "query"))

    return run


def eval_map(spark, d):
    out = evaluate.summary(*_judged(spark, d))
    return rounded(out, *(c for c in out.columns if c != "queries"))


def analyze_full(spark, d):
    """Terms of the full analyzer."""
    toks = analysis.full_tokens(documents(spark, d))
    return index.term_statistics(index.frequencies(toks))


def eval_report(spark, d):
    """All figures of the runs in one row per query."""
    out = evaluate.report(*_judged(spark, d))
    return rounded(out, *(c for c in out.columns if c != "query")).select("query", "p_5", "r_5", "f_5", "ndcg_5", "ip_5", "ap", "rr")


def eval_case_sensitive(spark, d):
    """Grades that differ in case from the known ones gain nothing."""
    grade = F.when(F.col("doc_id") % 2 == 0, "good").otherwise("Good")
    return evaluate.judgements(table(spark, d, "labels").select(F.lit(1).alias("query"), "doc_id", grade.alias("grade"), F.lit(0).alias("line")), True)


# Text, codes and tables

def postings_roundtrip(spark, d):
    """Positions after delta and variable-byte coding and back."""
    coded = codec.delta_postings(index.positional_postings(analysis.tokens(documents(spark, d)))).withColumn("gaps", codec.vbyte_decode(codec.vbyte_encode("gaps")).cast("array<int>"))
    return codec.undelta_postings(coded).select("term", "doc_id", F.col("tf").cast("long").alias("tf"), F.array_join("positions", ",").alias("positions"))


def merged_partials(spark, d):
    """Two partial indexes, of even and odd documents, merged."""
    tf = built(spark, d).tf
    parts = [tf.where(F.col("doc_id") % 2 == k).groupBy("term").agg(F.sort_array(F.collect_list("doc_id")).alias("items")) for k in (0, 1)]
    return index.merge_postings(parts).select("term", F.array_join("items", ",").alias("items"))


def equal_keys(spark, d):
    views = _views(spark, d)
    return stats.equal_keys(_ranks(spark, d).join(views.select("key"), "key", "left_semi"), views)


def page_titles(spark, d):
    return table(spark, d, "pages").select("page_id", analysis.page_title("html").alias("title"))


def short_urls(spark, d):
    return table(spark, d, "pages").select("page_id", analysis.short_url("url").alias("short"), F.url_decode(F.regexp_replace("url", "/", "%2F")).alias("decoded"))


def known_pages(spark, d):
    pages = table(spark, d, "pages").select(F.col("url").alias("name")).distinct()
    return analysis.known_names(pages, pages.where(F.col("name").like("%/en/%")))


def initials(spark, d):
    return documents(spark, d).select("doc_id", F.md5(analysis.remove_initials_dots(F.coalesce("text", F.lit("")))).alias("text"))


def suggestions_by_query(spark, d):
    """The most frequent continuations with ties in full."""
    return autocomplete.suggest(autocomplete.consolidate(_log(spark, d)), SUGGEST, 50, collapse_ties=False).withColumn("rank", F.col("rank").cast("long"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    plain = (
        corpus_stats, term_stats, postings_positional, postings_doconly, forward_topk, forward_no_stopwords, stopwords_topn, doc_norms, postings_delta_vbyte_size,
        match_and, match_or, match_phrase, match_phrase_doconly, fullscan_title, rank_bigram, prf_terms, prf_search, query_bhattacharyya,
        links_extracted, redirect_closure, pagerank_pages, pagerank_2iter, num_views, click_counts,
        rank_avg_ties, rank_tiebreak, spearman, pagerank_histogram, numviews_histogram, query_log_consolidated, autocomplete_topk, eval_map, analyze_full,
        rank_favorite, rank_batch, rank_cosine_full, match_phrase_full, rank_plain_cosine, rank_plain_ql, rank_combined, eval_report, eval_case_sensitive,
        postings_roundtrip, merged_partials, equal_keys, page_titles, short_urls, known_pages, initials, suggestions_by_query,
    )
    found = {f.__name__: f for f in plain}
    found |= {f"rank_{name}": _ranked(name) for name in ("cosine", "ql", "linear", "comprehensive", "conjunctive", "numviews")}
    found |= {
        "eval_precision": _evaluated(evaluate.precision_at),
        "eval_recall": _evaluated(evaluate.recall_at),
        "eval_f": _evaluated(evaluate.f_at),
        "eval_interp11": _evaluated(evaluate.interpolated_precision),
        "eval_ap": _evaluated(evaluate.average_precision),
        "eval_ndcg": _evaluated(evaluate.ndcg_at),
        "eval_rr": _evaluated(evaluate.reciprocal_rank),
    }
    return found


def oracle_sql() -> dict[str, str]:
    from . import oracle

    return oracle.statements()

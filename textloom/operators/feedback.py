"""Pseudo-relevance feedback and the similarity of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.query import PLAIN, Analyzer, query_tables
from .index import Index, without_stop_words
from .rank import search


def expansion_terms(index: Index, results: DataFrame, m: int = 10) -> DataFrame:
    """``query_id, term, count, prob``: the m most frequent terms of each query's results, no stop words."""
    counts = without_stop_words(index.tf.join(results.select("query_id", "doc_id"), "doc_id"), index.stops).groupBy("query_id", "term").agg(F.sum("tf").alias("count"))
    order = Window.partitionBy("query_id").orderBy(F.desc("count"), "term")
    kept = counts.withColumn("r", F.row_number().over(order)).where(F.col("r") <= m)
    return kept.select("query_id", "term", "count", (F.col("count") / F.sum("count").over(Window.partitionBy("query_id"))).alias("prob"))


def expand_query(text: str, expansion: list[tuple[str, float]], least: float = 0.05) -> str:
    """The query in lower case without quotation marks, and the likely terms that it does not yet contain as a substring."""
    text = text.lower().replace('"', " ")
    for term, prob in expansion:
        if prob >= least and term not in text:
            text = f"{text} {term}"
    return text


def expanded_search(spark, index: Index, queries: list[tuple[int, str]], name: str = "cosine", k: int = 10, m: int = 10, least: float = 0.05, signals: DataFrame | None = None, analyzer: Analyzer = PLAIN, **how) -> DataFrame:
    """Searches, adds each query's likely terms and searches again.

    The terms are collected with the queries, which the caller holds in the driver: m
    for each of them, and 1 / least, at most.
    """
    terms, phrases = query_tables(spark, queries, analyzer)
    found = search(index, terms, phrases, name, k, signals, **how)
    likely: dict[int, list[tuple[str, float]]] = {}
    for x in expansion_terms(index, found, m).where(F.col("prob") >= least).orderBy("query_id", F.desc("prob"), "term").collect():
        likely.setdefault(x["query_id"], []).append((x["term"], x["prob"]))
    expanded = [(q, expand_query(analyzer.normal(text), likely.get(q, []), least)) for q, text in queries]
    return search(index, *query_tables(spark, expanded, analyzer), name, k, signals, **how)


def bhattacharyya(distributions: DataFrame) -> DataFrame:
    """``query_a, query_b, similarity`` of all ordered pairs of different queries, 0 without a common term.

    ``distributions``: ``query_id, term, prob``; of equal terms the likelier counts.
    The result is a matrix by definition, so all pairs of queries are its size.
    """
    d = distributions.groupBy("query_id", "term").agg(F.max("prob").alias("prob"))
    shared = d.toDF("query_a", "term", "p").join(d.toDF("query_b", "term", "q"), "term").where("query_a <> query_b").groupBy("query_a", "query_b").agg(F.sum(F.sqrt(F.col("p") * F.col("q"))).alias("s"))
    ids = distributions.select("query_id").distinct()
    matrix = ids.toDF("query_a").crossJoin(ids.toDF("query_b")).where("query_a <> query_b")
    return matrix.join(shared, ["query_a", "query_b"], "left").select("query_a", "query_b", F.coalesce("s", F.lit(0.0)).alias("similarity"))

"""Which documents match: all operands, any, phrases.

Query tables are small and bounded by what users ask; they are broadcast to
the postings, which are filtered to the asked terms before any shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .index import Index, without_stop_words


def phrase_matches(toks: DataFrame, phrases: DataFrame) -> DataFrame:
    """``query_id, phrase_id, doc_id, starts``: documents with the phrase, and how often."""
    lengths = phrases.groupBy("query_id", "phrase_id").agg(F.count("*").alias("length"))
    placed = toks.join(F.broadcast(phrases), "term").groupBy("query_id", "phrase_id", "doc_id", (F.col("pos") - F.col("offset")).alias("start")).agg(F.count("*").alias("found"))
    return placed.join(F.broadcast(lengths), ["query_id", "phrase_id"]).where("found = length").groupBy("query_id", "phrase_id", "doc_id").agg(F.count("*").alias("starts"))


def phrase_terms_matches(tf: DataFrame, phrases: DataFrame) -> DataFrame:
    """As phrase_matches, from postings without positions: documents with all the words."""
    wanted = phrases.select("query_id", "phrase_id", "term").distinct()
    lengths = wanted.groupBy("query_id", "phrase_id").agg(F.count("*").alias("length"))
    found = tf.join(F.broadcast(wanted), "term").groupBy("query_id", "phrase_id", "doc_id").agg(F.count("*").alias("found"))
    return found.join(F.broadcast(lengths), ["query_id", "phrase_id"]).where("found = length").select("query_id", "phrase_id", "doc_id", F.lit(1).cast("long").alias("starts"))


def match_all(index: Index, terms: DataFrame, phrases: DataFrame, positions: bool = True) -> DataFrame:
    """``query_id, doc_id`` of documents with all phrases and all terms outside them that are no stop words.

    A query of stop words alone, or with an empty phrase, matches nothing.
    """
    operands = without_stop_words(terms.where("token_tf > 0"), index.stops).select("query_id", "term")
    by_term = index.tf.join(F.broadcast(operands), "term").select("query_id", "doc_id", F.concat(F.lit("t "), "term").alias("operand"))
    found = phrase_matches(index.toks, phrases) if positions else phrase_terms_matches(index.tf, phrases)
    by_phrase = found.select("query_id", "doc_id", F.concat(F.lit("p "), F.col("phrase_id").cast("string")).alias("operand"))
    needed = operands.select("query_id", F.concat(F.lit("t "), "term").alias("operand")).unionByName(phrases.select("query_id", F.concat(F.lit("p "), F.col("phrase_id").cast("string")).alias("operand")).distinct())
    counts = needed.groupBy("query_id").agg(F.count("*").alias("needed"))
    met = by_term.unionByName(by_phrase).groupBy("query_id", "doc_id").agg(F.count("*").alias("met"))
    return met.join(F.broadcast(counts), "query_id").where("met = needed").select("query_id", "doc_id")


def match_any(index: Index, terms: DataFrame) -> DataFrame:
    """``query_id, doc_id`` of documents with a term of the query that is no stop word."""
    operands = without_stop_words(terms, index.stops).select("query_id", "term")
    return index.tf.join(F.broadcast(operands), "term").select("query_id", "doc_id").distinct()

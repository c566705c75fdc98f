"""The inverted index as tables.

``frequencies(term, doc_id, tf)`` is the one large shuffle; terms, document
statistics and stop words are aggregations of it.  Scoring needs no positions,
so they are a table of their own, built where phrases ask for them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.analysis import tokens

STOPWORDS = 70


def positional_postings(toks: DataFrame) -> DataFrame:
    """``term, doc_id, tf, positions``, positions ascending."""
    return toks.groupBy("term", "doc_id").agg(F.count("*").cast("int").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))


def frequencies(toks: DataFrame) -> DataFrame:
    return toks.groupBy("term", "doc_id").agg(F.count("*").alias("tf"))


def document_postings(toks: DataFrame) -> DataFrame:
    return toks.select("term", "doc_id").distinct()


def term_statistics(tf: DataFrame) -> DataFrame:
    """``term, df, ctf``."""
    return tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("ctf"))


def stop_words(terms: DataFrame, n: int = STOPWORDS) -> DataFrame:
    """The n most frequent terms, ties by term."""
    return terms.orderBy(F.desc("ctf"), "term").limit(n).select("term", "ctf")


def corpus_totals(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``n_docs, n_terms, n_tokens`` in one row."""
    one = terms.agg(F.count("*").alias("n_terms"), F.coalesce(F.sum("ctf"), F.lit(0)).alias("n_tokens"))
    return docs.agg(F.count("*").alias("n_docs")).crossJoin(F.broadcast(one))  # one row each


def idf(n_docs: int) -> Column:
    return 1 + F.log2(F.lit(float(n_docs)) / F.col("df"))


def document_statistics(tf: DataFrame, terms: DataFrame, n_docs: int) -> DataFrame:
    """``doc_id, size, norm2``: tokens with stop words, and the squared length of the TF-IDF vector."""
    weighed = tf.join(terms.select("term", "df"), "term")
    return weighed.groupBy("doc_id").agg(F.sum("tf").alias("size"), F.sum(F.pow(F.col("tf") * idf(n_docs), F.lit(2.0))).alias("norm2"))


def forward_index(tf: DataFrame, top: int | None = None) -> DataFrame:
    """``doc_id, rank, term, tf``: each document's terms by frequency, ties by term."""
    ranked = tf.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("tf"), "term")).alias("rank"), "term", "tf")
    return ranked if top is None else ranked.where(F.col("rank") <= top)


def without_stop_words(rows: DataFrame, stops: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(stops.select("term")), "term", "left_anti")  # a fixed number of terms


def merge_postings(parts: list[DataFrame]) -> DataFrame:
    """Postings of several partial indexes as one; lists of a term follow the order of the parts."""
    tagged = [p.select("term", F.lit(k).alias("part"), "items") for k, p in enumerate(parts)]
    every = tagged[0]
    for p in tagged[1:]:
        every = every.unionByName(p)
    return every.groupBy("term").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("part", "items"))), lambda x: x["items"])).alias("items"))


@dataclass
class Index:
    """The tables of one corpus; ``documents`` keeps what results show."""

    documents: DataFrame
    toks: DataFrame
    tf: DataFrame
    terms: DataFrame
    stops: DataFrame
    stats: DataFrame
    n_docs: int
    n_tokens: int

    @classmethod
    def build(cls, docs: DataFrame, n_stops: int = STOPWORDS, analyze=tokens) -> Index:
        toks = analyze(docs)
        tf = frequencies(toks).persist()
        terms = term_statistics(tf).persist()
        return cls.of(docs, toks, tf, terms, n_stops)

    @classmethod
    def of(cls, docs: DataFrame, toks: DataFrame, tf: DataFrame, terms: DataFrame, n_stops: int) -> Index:
        n_docs = docs.count()
        n_tokens = terms.agg(F.coalesce(F.sum("ctf"), F.lit(0))).first()[0]
        stops = stop_words(terms, n_stops).toArrow()  # a fixed number of terms
        return cls(docs, toks, tf, terms, docs.sparkSession.createDataFrame(stops), document_statistics(tf, terms, n_docs).persist(), n_docs, n_tokens)

    def save(self, path: str) -> None:
        """Tables sorted by their key, so that readers of few terms skip row groups."""
        self.documents.write.parquet(f"{path}/documents")
        self.toks.sortWithinPartitions("term", "doc_id").write.parquet(f"{path}/tokens")
        self.tf.repartition("term").sortWithinPartitions("term", "doc_id").write.parquet(f"{path}/frequencies")
        self.terms.sortWithinPartitions("term").write.parquet(f"{path}/terms")

    @classmethod
    def load(cls, spark: SparkSession, path: str, n_stops: int = STOPWORDS) -> Index:
        read = lambda name: spark.read.parquet(f"{path}/{name}")
        return cls.of(read("documents"), read("tokens"), read("frequencies"), read("terms"), n_stops)

    def unpersist(self) -> None:
        self.stats.unpersist()
        self.tf.unpersist()
        self.terms.unpersist()

"""Scores of matching documents, and the best of each query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.analysis import plain_terms
from .index import Index, idf
from .retrieve import match_all

#: Weights and ranges of the score fusions.
LINEAR_COSINE, LINEAR_QL, LINEAR_PHRASE, LINEAR_VIEWS = 0.8, 9.0, 300.0, 20000.0
ALPHA, BETA = 0.75, 1e-6
PAGERANK_RANGE = (1.0040161e-5, 0.01712521)
VIEWS_RANGE = (0.0, 420930.0)


def top_k(scored: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, rank, doc_id, score``: score descending, then doc_id; scores that differ by the order of a sum are equal."""
    best = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 10)), "doc_id")
    return scored.select("query_id", F.row_number().over(best).alias("rank"), "doc_id", "score").where(F.col("rank") <= k)


def cosine(index: Index, terms: DataFrame, candidates: DataFrame) -> DataFrame:
    """``query_id, doc_id, score``; stop words lengthen the query vector and add nothing to the product."""
    weights = F.broadcast(terms).join(index.terms, "term").select("query_id", "term", (F.col("qtf") * idf(index.n_docs)).alias("q"), idf(index.n_docs).alias("idf"))
    length = weights.groupBy("query_id").agg(F.sum(F.col("q") * F.col("q")).alias("q2"))
    scoring = weights.join(F.broadcast(index.stops.select("term")), "term", "left_anti")
    dots = index.tf.join(F.broadcast(scoring), "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("q") * F.col("tf") * F.col("idf")).alias("dot"))
    out = candidates.join(dots, ["query_id", "doc_id"], "left").join(index.stats, "doc_id").join(F.broadcast(length), "query_id")
    norm = F.sqrt(F.col("q2") * F.col("norm2"))
    return out.select("query_id", "doc_id", F.when(norm == 0, 0.0).otherwise(F.coalesce("dot", F.lit(0.0)) / norm).alias("score"))


def query_likelihood(index: Index, terms: DataFrame, candidates: DataFrame, mix: float = 0.5) -> DataFrame:
    """Jelinek-Mercer over the tokens outside phrases; stop words count as absent from the document."""
    stops = index.stops.select("term", F.lit(True).alias("stop"))
    words = F.broadcast(terms.where("token_tf > 0")).join(index.terms, "term").join(F.broadcast(stops), "term", "left").select("query_id", "term", "token_tf", "ctf", F.coalesce("stop", F.lit(False)).alias("stop"))
    pairs = candidates.join(F.broadcast(words), "query_id").join(index.stats.select("doc_id", "size"), "doc_id")
    asked = index.tf.join(F.broadcast(words.select("term").distinct()), "term", "left_semi")
    held = pairs.join(asked, ["term", "doc_id"], "left")
    p = mix * F.when(F.col("stop"), 0).otherwise(F.coalesce("tf", F.lit(0))) / F.col("size") + (1 - mix) * F.col("ctf") / F.lit(float(max(index.n_tokens, 1)))
    part = F.when(p > 0, F.col("token_tf") * F.ln(p)).otherwise(F.lit(float("-inf")))
    sums = held.groupBy("query_id", "doc_id").agg(F.sum(part).alias("score"))
    return candidates.join(sums, ["query_id", "doc_id"], "left").select("query_id", "doc_id", F.coalesce("score", F.lit(0.0)).alias("score"))


def _with_signals(rows: DataFrame, signals: DataFrame | None) -> DataFrame:
    """Adds ``page_rank`` and ``views``, 0 where a document has none."""
    if signals is None:
        return rows.withColumns({"page_rank": F.lit(0.0), "views": F.lit(0).cast("long")})
    return rows.join(signals.select("doc_id", "page_rank", "views"), "doc_id", "left").withColumns({"page_rank": F.coalesce("page_rank", F.lit(0.0)), "views": F.coalesce("views", F.lit(0))})


def linear(index: Index, terms: DataFrame, candidates: DataFrame, signals: DataFrame | None = None, mix: float = 0.5) -> DataFrame:
    both = cosine(index, terms, candidates).withColumnRenamed("score", "c").join(query_likelihood(index, terms, candidates, mix).withColumnRenamed("score", "l"), ["query_id", "doc_id"])
    score = F.col("c") / LINEAR_COSINE + F.col("l") / LINEAR_QL + F.col("views") / LINEAR_VIEWS
    return _with_signals(both, signals).select("query_id", "doc_id", score.alias("score"))


def comprehensive(index: Index, terms: DataFrame, candidates: DataFrame, signals: DataFrame | None = None, pagerank_range=PAGERANK_RANGE, views_range=VIEWS_RANGE) -> DataFrame:
    scale = lambda c, r: (F.col(c) - r[0]) / (r[1] - r[0])
    seen = BETA * scale("page_rank", pagerank_range) + (1 - BETA) * scale("views", views_range)
    rows = _with_signals(cosine(index, terms, candidates), signals)
    return rows.select("query_id", "doc_id", (ALPHA * F.col("score") + (1 - ALPHA) * seen).alias("score"))


def conjunctive(index: Index, terms: DataFrame, candidates: DataFrame) -> DataFrame:
    return candidates.select("query_id", "doc_id", F.lit(1.0).alias("score"))


def views_rank(index: Index, terms: DataFrame, candidates: DataFrame, signals: DataFrame | None = None) -> DataFrame:
    return _with_signals(candidates, signals).select("query_id", "doc_id", F.col("views").cast("double").alias("score"))


def title_match(titles: DataFrame, terms: DataFrame) -> DataFrame:
    """1 for documents whose title holds a word of the query, else 0; every document is scored.

    ``titles``: ``doc_id, title``.  The words of each query are one array, so each
    title is read once for all queries of the batch.
    """
    asked = terms.groupBy("query_id").agg(F.collect_set("term").alias("words")).agg(F.collect_list(F.struct("query_id", "words")).alias("asked"))
    rows = titles.select("doc_id", plain_terms("title").alias("t")).crossJoin(F.broadcast(asked)).select("doc_id", "t", F.explode("asked").alias("a"))  # one row: the batch of queries
    return rows.select("a.query_id", "doc_id", F.when(F.arrays_overlap("t", "a.words"), 1.0).otherwise(0.0).alias("score"))


def bigram_rank(index: Index, bigrams: DataFrame) -> DataFrame:
    """How often a document has neighbouring words of the query next to each other; ``bigrams``: ``query_id, first, second``.

    ``second`` is null for a query of one word, whose frequency counts.
    """
    asked = F.broadcast(bigrams)
    pairs = index.toks.alias("a").join(asked.where("second IS NOT NULL").alias("q"), F.col("a.term") == F.col("q.first")).select("query_id", "doc_id", (F.col("pos") + 1).alias("pos"), F.col("second").alias("term"))
    wanted = index.toks.join(asked.select(F.col("second").alias("term")).where("term IS NOT NULL").distinct(), "term", "left_semi")
    counted = pairs.join(wanted, ["doc_id", "pos", "term"]).groupBy("query_id", "doc_id").agg(F.count("*").cast("double").alias("score"))
    single = index.tf.join(asked.where("second IS NULL").select("query_id", F.col("first").alias("term")), "term").select("query_id", "doc_id", F.col("tf").cast("double").alias("score"))
    return counted.unionByName(single)


def every_document(index: Index, terms: DataFrame) -> DataFrame:
    """``query_id, doc_id``: all documents for each query of the batch, as the rankers without matching score them."""
    return index.documents.select("doc_id").crossJoin(F.broadcast(terms.select("query_id").distinct())).select("query_id", "doc_id")  # the batch of queries


def plain_cosine(index: Index, terms: DataFrame) -> DataFrame:
    """``query_id, doc_id, score`` of all documents: without stop words or matching, the ratio in the idf cut to an integer."""
    whole = lambda: 1 + F.log2(F.floor(F.lit(float(index.n_docs)) / F.col("df")).cast("double"))
    weights = F.broadcast(terms).join(index.terms, "term").select("query_id", "term", (F.col("qtf") * whole()).alias("q"), whole().alias("idf"))
    length = weights.groupBy("query_id").agg(F.sum(F.col("q") * F.col("q")).alias("q2"))
    norms = index.tf.join(index.terms.select("term", "df"), "term").groupBy("doc_id").agg(F.sum(F.pow(F.col("tf") * whole(), F.lit(2.0))).alias("norm2"))
    dots = index.tf.join(F.broadcast(weights), "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("q") * F.col("tf") * F.col("idf")).alias("dot"))
    scored = dots.join(norms, "doc_id").join(F.broadcast(length), "query_id").select("query_id", "doc_id", (F.col("dot") / F.sqrt(F.col("q2") * F.col("norm2"))).alias("score"))
    return every_document(index, terms).join(scored, ["query_id", "doc_id"], "left").select("query_id", "doc_id", F.coalesce("score", F.lit(0.0)).alias("score"))


def plain_likelihood(index: Index, terms: DataFrame, mix: float = 0.5) -> DataFrame:
    """``query_id, doc_id, score`` of all documents by query likelihood, without stop words or matching; empty documents by the corpus alone."""
    words = F.broadcast(terms.where("token_tf > 0")).join(index.terms, "term").select("query_id", "term", "token_tf", (mix * F.col("ctf") / F.lit(float(max(index.n_tokens, 1)))).alias("behind"))
    bases = words.groupBy("query_id").agg(F.sum(F.col("token_tf") * F.ln("behind")).alias("base"))
    held = index.tf.join(F.broadcast(words), "term").join(index.stats.select("doc_id", "size"), "doc_id")
    more = held.groupBy("query_id", "doc_id").agg(F.sum(F.col("token_tf") * (F.ln((1 - mix) * F.col("tf") / F.col("size") + F.col("behind")) - F.ln("behind"))).alias("more"))
    rows = every_document(index, terms).join(F.broadcast(bases), "query_id", "left").join(more, ["query_id", "doc_id"], "left")
    return rows.select("query_id", "doc_id", (F.coalesce("base", F.lit(0.0)) + F.coalesce("more", F.lit(0.0))).alias("score"))


def combined_rank(index: Index, terms: DataFrame, candidates: DataFrame, bigrams: DataFrame, signals: DataFrame | None = None) -> DataFrame:
    """Cosine, likelihood, neighbouring words and views in one sum."""
    base = linear(index, terms, candidates, signals)
    near = bigram_rank(index, bigrams).withColumnRenamed("score", "b")
    return base.join(near, ["query_id", "doc_id"], "left").select("query_id", "doc_id", (F.col("score") + F.coalesce("b", F.lit(0.0)) / LINEAR_PHRASE).alias("score"))


RANKERS: dict[str, Callable[..., DataFrame]] = {
    "cosine": cosine,
    "favorite": cosine,
    "ql": query_likelihood,
    "linear": linear,
    "comprehensive": comprehensive,
    "conjunctive": conjunctive,
    "numviews": views_rank,
}
WITH_SIGNALS = ("linear", "comprehensive", "numviews")
WITH_MIX = ("ql", "linear")


def ranker(name: str) -> Callable[..., DataFrame]:
    if name not in RANKERS:
        raise ValueError(f"not a ranker: {name}")
    return RANKERS[name]


def search(index: Index, terms: DataFrame, phrases: DataFrame, name: str = "cosine", k: int = 10, signals: DataFrame | None = None, positions: bool = True, mix: float = 0.5) -> DataFrame:
    """The best k documents of every query of the batch; without ``positions`` phrases match as their words do."""
    score = ranker(name)
    candidates = match_all(index, terms, phrases, positions)
    more = {"signals": signals} if name in WITH_SIGNALS else {}
    if name in WITH_MIX:
        more["mix"] = mix
    return top_k(score(index, terms, candidates, **more), k)


def batch(index: Index, terms: DataFrame, phrases: DataFrame, names: list[str], k: int = 10, signals: DataFrame | None = None) -> DataFrame:
    """Several rankers over one batch: ``ranker, query_id, rank, doc_id, score``."""
    parts = [search(index, terms, phrases, n, k, signals).select(F.lit(n).alias("ranker"), "*") for n in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out

"""Links of pages, redirects, and PageRank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A link to a page of the same folder; any link; a redirect.
LOCAL_LINK = r'<[a|A].*?href="([^ /#]*)".*?>'
ANY_LINK = r'<[aA]\b[^>]*?href="([^"]*)"'
REDIRECT = r'<[meta|META].*http-equiv="refresh".*content=".*url=(.*)">'


def cut(df: DataFrame) -> DataFrame:
    """The table without its lineage, in the session's checkpoint folder, or in the warehouse where none is set."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/textloom-checkpoints")
    return df.checkpoint()


def _lines(pages: DataFrame) -> DataFrame:
    return pages.select("url", F.posexplode(F.split(F.coalesce("html", F.lit("")), "\n")).alias("line", "text"))


def redirects(pages: DataFrame) -> DataFrame:
    """``url, target`` of pages whose first redirect stands on or before the line of their first link."""
    marks = _lines(pages).select("url", "line", F.regexp_extract("text", REDIRECT, 1).alias("target"), F.col("text").rlike(REDIRECT).alias("moved"), F.col("text").rlike(LOCAL_LINK).alias("links"))
    first = marks.where("moved OR links").groupBy("url").agg(F.min(F.when(F.col("moved"), F.struct("line", "target"))).alias("m"), F.min(F.when(F.col("links"), F.col("line"))).alias("link"))
    return first.where("m IS NOT NULL AND (link IS NULL OR m.line <= link)").select("url", F.col("m.target").alias("target"))


def links(pages: DataFrame, pattern: str = LOCAL_LINK) -> DataFrame:
    """``url, line, target``, with repeats; a page's links end at its first redirect."""
    marked = _lines(pages)
    stop = marked.where(F.col("text").rlike(REDIRECT)).groupBy("url").agg(F.min("line").alias("stop"))
    found = marked.where(F.col("text").rlike(pattern)).select("url", "line", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("target"))
    return found.join(stop, "url", "left").where("stop IS NULL OR line < stop").select("url", "line", "target")


def close_redirects(moves: DataFrame) -> DataFrame:
    """``url, target`` with the end of each chain; chains that never end are dropped.

    Of a page's targets the smallest counts.  Pointers double their reach each round
    until all are settled: those at their end stay, and rows that still move after
    as many rounds as a chain through all redirects takes are cycles.
    """
    now = cut(moves.groupBy("url").agg(F.min("target").alias("target")))
    heads = now.select(F.col("url").alias("target"))
    reach, most = 1, now.count()
    while reach < most and not now.join(heads, "target", "left_semi").isEmpty():
        onward = now.select(F.col("url").alias("target"), F.col("target").alias("further"))
        now = cut(now.join(onward, "target", "left").select("url", F.coalesce("further", "target").alias("target")))
        reach *= 2
    return now.join(heads, "target", "left_anti").select("url", "target")


def build_graph(pages: DataFrame, pattern: str = LOCAL_LINK) -> tuple[DataFrame, DataFrame]:
    """Nodes (pages that are no redirects) and edges ``src, dst`` between them, with repeats, chased through redirects."""
    moved = redirects(pages)
    nodes = pages.select(F.col("url").alias("node")).distinct().join(moved.select(F.col("url").alias("node")), "node", "left_anti")
    ends = close_redirects(moved).toDF("target", "end")
    followed = links(pages, pattern).join(nodes.select(F.col("node").alias("url")), "url", "left_semi").join(ends, "target", "left").select(F.col("url").alias("src"), F.coalesce("end", "target").alias("dst"))
    return nodes, followed.join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst")


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.1, iterations: int = 2, dedupe_outlinks: bool = False) -> DataFrame:
    """``node, page_rank``.

    A page passes its rank on in parts by all its links, repeats included, but a
    target takes one part from each page; pages without links pass nothing on.
    """
    pairs = edges.select("src", "dst").distinct()
    parts = (pairs if dedupe_outlinks else edges).groupBy("src").agg(F.count("*").alias("out"))
    shares = pairs.join(parts, "src").select("src", "dst", "out").persist()
    n = nodes.count()
    ranks = nodes.select("node", F.lit(1.0 / max(n, 1)).alias("page_rank"))
    for k in range(iterations):
        got = shares.join(ranks, F.col("src") == F.col("node")).groupBy("dst").agg(F.sum(F.col("page_rank") / F.col("out")).alias("got"))
        ranks = nodes.join(got, F.col("node") == F.col("dst"), "left").select("node", ((1 - damping) * F.coalesce("got", F.lit(0.0)) + damping / max(n, 1)).alias("page_rank"))
        if k % 5 == 4:
            ranks = cut(ranks)
    return ranks

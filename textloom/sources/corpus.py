"""Readers and writers with fixed schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def corpus_directory(spark: SparkSession, path: str, recursive: bool = False, hidden: bool = False) -> DataFrame:
    """``doc_id, url, text``: one file is one document, named by its file.

    Files are numbered by name: numeric names in numeric order, then the others.
    """
    files = spark.read.option("recursiveFileLookup", recursive).text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("url"), F.col("value").alias("text"))
    if not hidden:
        files = files.where(~F.col("url").startswith("."))
    # Numbers come from the names alone; texts are joined to them afterwards.
    order = Window.orderBy(F.expr("try_cast(url AS BIGINT)").asc_nulls_last(), "url")
    numbers = files.select("url").distinct().select("url", (F.row_number().over(order) - 1).cast("long").alias("doc_id"))
    return files.join(numbers, "url").select("doc_id", "url", "text")


def corpus_tsv(spark: SparkSession, path: str) -> DataFrame:
    """``title, body, num_views``."""
    return spark.read.csv(path, sep="\t", schema="title string, body string, num_views int", quote="", escape="")


def view_log(spark: SparkSession, path: str) -> DataFrame:
    """``lang, article, views``; lines of other than three fields are dropped, views stay text."""
    parts = spark.read.text(path).select(F.split("value", " ").alias("p")).where(F.size("p") == 3)
    return parts.select(*(F.col("p")[k].alias(n) for k, n in enumerate(("lang", "article", "views"))))


def query_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("value").alias("query"))


def query_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """``file, line, value`` in file order."""
    lines = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.posexplode(F.split("value", "\n")).alias("line", "value"))
    return lines.where("value != ''")


def qrels(spark: SparkSession, path: str) -> DataFrame:
    """``query, doc_id, grade, line``; fields after the third are ignored."""
    p = F.split("value", "\t")
    return _numbered(spark, path).where(F.size(p) >= 3).select(p[0].alias("query"), p[1].cast("long").alias("doc_id"), p[2].alias("grade"), "line")


def run_files(spark: SparkSession, path: str) -> DataFrame:
    """``query, rank, doc_id``: the order of a file's lines is the ranking."""
    p = F.split("value", "\t")
    return _numbered(spark, path).where(F.size(p) >= 2).select(p[0].alias("query"), (F.col("line") + 1).alias("rank"), p[1].cast("long").alias("doc_id"))


def write_runs(results: DataFrame, path: str) -> None:
    """A folder per query with lines ``query<tab>doc_id`` in rank order; ``results``: ``query, rank, doc_id``."""
    lines = results.select("query", F.concat_ws("\t", "query", F.col("doc_id").cast("string")).alias("value"), "rank")
    lines.repartition("query").sortWithinPartitions("query", "rank").select(F.md5("query").alias("part"), "value").write.partitionBy("part").text(path)


def write_ranks(values: DataFrame, path: str, as_text: bool = False) -> None:
    """``name, value`` as Parquet, or as lines ``name value``."""
    if as_text:
        values.select(F.concat_ws(" ", "name", F.col("value").cast("string")).alias("value")).write.text(path)
    else:
        values.write.parquet(path)


def read_ranks(spark: SparkSession, path: str, as_text: bool = False) -> DataFrame:
    if not as_text:
        return spark.read.parquet(path)
    p = F.split("value", " ")
    return spark.read.text(path).where(F.size(p) == 2).select(p[0].alias("name"), p[1].cast("double").alias("value"))


def term_distributions(spark: SparkSession, path: str) -> DataFrame:
    """``query_id, term, prob`` from files of lines ``term<tab>prob``, one per query, named by it."""
    p = F.split("value", "\t")
    return _numbered(spark, path).where(F.size(p) == 2).select(F.col("file").alias("query_id"), p[0].alias("term"), p[1].cast("double").alias("prob"))


def clicked_urls(spark: SparkSession, path: str) -> DataFrame:
    """Distinct fifth columns of a search log with a header; rows of other than five columns are dropped."""
    p = F.split("value", "\t")
    return spark.read.text(path).where((F.size(p) == 5) & ~F.col("value").startswith("AnonID")).select(p[4].alias("url")).where("url != ''").distinct()


def append_clicks(clicks: DataFrame, path: str) -> None:
    clicks.write.mode("append").csv(path, sep="\t")


CLICKS = "session string, query string, doc_id string, action string, ts_ms long"


def read_clicks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=CLICKS)


def fetch(pages: DataFrame, name: str) -> DataFrame:
    """The stored page of a name; the filter reaches the scan."""
    return pages.where(F.col("url") == name).select("url", "html")

"""Click and query logs as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.analysis import clean_log_query
from ..sources.corpus import CLICKS


def click_stream(spark: SparkSession, path: str) -> DataFrame:
    """The click log as it grows, with event time ``ts``."""
    return spark.readStream.schema(CLICKS).csv(path, sep="\t").withColumn("ts", F.timestamp_millis("ts_ms"))


def sessions(clicks: DataFrame, gap: str = "60 seconds", late: str = "10 minutes") -> DataFrame:
    """``session, start, end, clicks``; a session ends after a gap."""
    return clicks.withWatermark("ts", late).groupBy("session", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("clicks")).select("session", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "clicks")


def clicks_per_window(clicks: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """``start, doc_id, clicks`` in tumbling windows."""
    return clicks.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "doc_id").agg(F.count("*").alias("clicks")).select(F.col("w.start").alias("start"), "doc_id", "clicks")


def query_counts(lines: DataFrame) -> DataFrame:
    """Running counts of cleaned queries, from lines of a query log."""
    return lines.select(clean_log_query(F.split("value", "\t")[0]).alias("query")).groupBy("query").agg(F.count("*").alias("cnt"))

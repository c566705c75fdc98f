"""Suggestions from a query log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.analysis import clean_log_query


def clean_log(lines: DataFrame) -> DataFrame:
    """``query, cnt`` from text lines ``query`` or ``query<tab>count``; lines of more fields are refused."""
    parts = F.split("value", "\t")
    checked = F.when(F.size(parts) > 2, F.raise_error(F.lit("a line of the query log has more than two fields"))).otherwise(F.expr("try_cast(try_element_at(split(value, '\t'), 2) AS BIGINT)"))
    return lines.select(clean_log_query(F.element_at(parts, 1)).alias("query"), F.coalesce(checked, F.lit(1)).alias("cnt"))


def consolidate(log: DataFrame) -> DataFrame:
    """``query, cnt`` with equal queries summed; a missing count is 1."""
    return log.groupBy("query").agg(F.sum(F.coalesce("cnt", F.lit(1))).alias("cnt"))


def prepare(log: DataFrame, path: str) -> None:
    """Writes the consolidated log in order of queries, for prefix scans that skip files."""
    consolidate(log).repartitionByRange("query").sortWithinPartitions("query").write.mode("overwrite").parquet(path)


def suggest(log: DataFrame, prefix: str, k: int = 5, collapse_ties: bool = True) -> DataFrame:
    """``rank, suggestion, cnt``: the most frequent continuations of the prefix.

    With ``collapse_ties`` queries of one count leave the first of them only.  A
    prefix of fewer than three characters, or without a match, gives no row.
    """
    found = log.where(F.col("query").startswith(prefix) & F.lit(len(prefix) >= 3))
    if collapse_ties:
        found = found.groupBy("cnt").agg(F.min("query").alias("query"))
    best = found.orderBy(F.desc("cnt"), "query").limit(k)
    return best.select(F.row_number().over(Window.orderBy(F.desc("cnt"), "query")).alias("rank"), F.substring("query", len(prefix) + 1, 1 << 30).alias("suggestion"), "cnt")


def record(query: DataFrame, path: str) -> None:
    """Appends to the log; suggestions show it after the next ``prepare``."""
    query.select(clean_log_query("query").alias("query"), F.lit(1).cast("long").alias("cnt")).write.mode("append").parquet(path)

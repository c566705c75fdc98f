"""The corpus pipeline: documents in, a decontaminated mix out.

Each stage takes (spark, docs, sf_dir) and returns a table; it is written as
Parquet, and the next stage reads it.  Nulls, empty tables and the like have
the results that the operators' modules state; documents that line
deduplication leaves without a word are dropped.  A stage begins by deleting
the intermediate tables of the stage before it, whose result is written by then.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import WORD, owner, remove, stored
from textloom.llm.decontamination import without_items
from textloom.llm.line_dedup import dedup_lines
from textloom.llm.mixing import mix_sources
from textloom.llm.near_dedup import one_of_each
from textloom.llm.quality_model import good_only

#: Near duplicates in the pipeline: words of a shingle, percent of similarity.
NEAR_SHINGLE, NEAR_PERCENT = 5, 80

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def stage(f: Stage) -> Stage:
    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        remove(spark, __name__)
        with owner(__name__):
            return f(spark, docs, sf_dir)

    return run_stage


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return good_only(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@stage
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of lines go."""
    return dedup_lines(docs).where(F.col("text").rlike(WORD)).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


@stage
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return one_of_each(docs, NEAR_SHINGLE, NEAR_PERCENT)


@stage
def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return without_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mix_sources(docs)


STAGES = [("quality classifier", quality), ("line dedup", lines), ("near duplicates", near), ("decontamination", benchmark), ("mixing", mix)]

#: The classifier cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stored(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs

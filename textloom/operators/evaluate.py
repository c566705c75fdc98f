"""Quality of retrieval runs against judgements.

A run is ``query, rank, doc_id``, judgements are ``query, doc_id, gain``.  A
document is relevant if its gain is above 1; unjudged ones are not.  Queries
without any judgement are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The gains of grades.
GAINS = {"perfect": 10.0, "excellent": 7.0, "good": 5.0, "fair": 1.0}
LEVELS = tuple(i / 10 for i in range(11))


def judgements(qrels: DataFrame, case_sensitive: bool = False) -> DataFrame:
    """``query, doc_id, gain`` from ``query, doc_id, grade, line``; of repeats the last line counts."""
    grade = F.col("grade") if case_sensitive else F.lower("grade")
    gain = F.coalesce(*(F.when(grade == (k.capitalize() if case_sensitive else k), v) for k, v in GAINS.items()), F.lit(0.0))
    return qrels.groupBy("query", "doc_id").agg(F.max_by(gain, "line").alias("gain"))


def judged_run(run: DataFrame, judged: DataFrame) -> DataFrame:
    """``query, rank, doc_id, gain, rel`` and running figures; ranks are counted anew from 1."""
    rows = run.join(judged.select("query").distinct(), "query", "left_semi").join(judged, ["query", "doc_id"], "left")
    w = Window.partitionBy("query").orderBy("rank")
    rows = rows.select("query", F.row_number().over(w).alias("rank"), "doc_id", F.coalesce("gain", F.lit(0.0)).alias("gain")).withColumn("rel", (F.col("gain") > 1).cast("long"))
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"hits": F.sum("rel").over(so_far), "all_hits": F.sum("rel").over(Window.partitionBy("query"))})
    return rows.withColumns({"precision": F.col("hits") / F.col("rank"), "recall": F.when(F.col("all_hits") > 0, F.col("hits") / F.col("all_hits")).otherwise(0.0)})


def _at(rows: DataFrame, ks: tuple[int, ...], make) -> DataFrame:
    return rows.groupBy("query").agg(*(make(k) for k in ks))


def _hits(k: int):
    return F.sum(F.when(F.col("rank") <= k, F.col("rel")).otherwise(0))


def _precision(k: int):
    return _hits(k) / F.lit(k)


def _recall(k: int):
    return F.when(F.sum("rel") > 0, _hits(k) / F.sum("rel")).otherwise(0.0)


def _f(k: int):
    p, r = _precision(k), _recall(k)
    return F.when((p == 0) | (r == 0), 0.0).otherwise(1 / (0.5 / p + 0.5 / r))


def precision_at(rows: DataFrame, ks=(1, 5, 10)) -> DataFrame:
    return _at(rows, ks, lambda k: _precision(k).alias(f"p_{k}"))


def recall_at(rows: DataFrame, ks=(1, 5, 10), relevant: DataFrame | None = None) -> DataFrame:
    """Out of the relevant documents in the run, or of all in ``relevant`` (judgements) where given."""
    if relevant is None:
        return _at(rows, ks, lambda k: _recall(k).alias(f"r_{k}"))
    every = relevant.where("gain > 1").groupBy("query").agg(F.count("*").alias("all"))
    got = _at(rows, ks, lambda k: _hits(k).alias(f"h_{k}")).join(every, "query", "left")
    return got.select("query", *(F.when(F.col("all") > 0, F.col(f"h_{k}") / F.col("all")).otherwise(0.0).alias(f"r_{k}") for k in ks))


def f_at(rows: DataFrame, ks=(1, 5, 10)) -> DataFrame:
    return _at(rows, ks, lambda k: _f(k).alias(f"f_{k}"))


def interpolated_precision(rows: DataFrame) -> DataFrame:
    """Largest precision at a relevant rank of at least the recall, for 11 levels ``ip_0`` to ``ip_10``."""
    best = lambda level: F.coalesce(F.max(F.when((F.col("rel") == 1) & (F.col("recall") >= level), F.col("precision"))), F.lit(0.0))
    return rows.groupBy("query").agg(*(best(level).alias(f"ip_{i}") for i, level in enumerate(LEVELS)))


def average_precision(rows: DataFrame) -> DataFrame:
    return rows.groupBy("query").agg(F.coalesce(F.avg(F.when(F.col("rel") == 1, F.col("precision"))), F.lit(0.0)).alias("ap"))


def reciprocal_rank(rows: DataFrame) -> DataFrame:
    return rows.groupBy("query").agg(F.coalesce(1 / F.min(F.when(F.col("rel") == 1, F.col("rank"))), F.lit(0.0)).alias("rr"))


def _discounted(gain: str, rank: str, k: int):
    return F.sum(F.when(F.col(rank) <= k, F.col(gain) / F.when(F.col(rank) == 1, 1.0).otherwise(F.log2(F.col(rank).cast("double")))).otherwise(0.0))


def ndcg_at(rows: DataFrame, ks=(1, 5, 10)) -> DataFrame:
    """The ideal order is that of the same first k documents."""
    for k in ks:
        w = Window.partitionBy("query", F.col("rank") <= k).orderBy(F.desc("gain"), "rank")
        rows = rows.withColumn(f"ideal_{k}", F.when(F.col("rank") <= k, F.row_number().over(w)))
    sums = rows.groupBy("query").agg(*(x for k in ks for x in (_discounted("gain", "rank", k).alias(f"d_{k}"), _discounted("gain", f"ideal_{k}", k).alias(f"i_{k}"))))
    return sums.select("query", *(F.when(F.col(f"i_{k}") > 0, F.col(f"d_{k}") / F.col(f"i_{k}")).otherwise(0.0).alias(f"ndcg_{k}") for k in ks))


def report(run: DataFrame, judged: DataFrame) -> DataFrame:
    """All figures of every query in one row."""
    rows = judged_run(run, judged)
    out = precision_at(rows)
    for part in (recall_at(rows), f_at(rows), ndcg_at(rows), interpolated_precision(rows), average_precision(rows), reciprocal_rank(rows)):
        out = out.join(part, "query")
    return out


def summary(run: DataFrame, judged: DataFrame) -> DataFrame:
    """Mean average precision and mean interpolated precision over the judged queries."""
    rows = judged_run(run, judged)
    both = average_precision(rows).join(interpolated_precision(rows), "query")
    return both.agg(F.count("*").alias("queries"), F.avg("ap").alias("map"), *(F.avg(f"ip_{i}").alias(f"ip_{i}") for i in range(len(LEVELS))))

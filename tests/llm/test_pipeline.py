import random
import shutil

from pyspark.sql import functions as F

from .brute import DOCUMENTS, collected, corpus, empty, odd, prose

import corpus_pipeline


def test_stages(spark, tmp_path):
    rows = corpus(80, 12)
    odd(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    item = " ".join(rows[20][1].split()[:30])
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, columns = docs, docs.columns
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
        if k < 4:
            assert docs.columns == columns and docs.count() <= before.count()
            assert {r[0] for r in collected(docs, "doc_id")} <= {r[0] for r in collected(before, "doc_id")}
    assert docs.count() == spark.read.parquet(f"{tmp_path}/out3").count() > 0
    assert 20 not in {r[0] for r in collected(docs, "doc_id")}
    assert collected(corpus_pipeline.run(spark, str(tmp_path)), "doc_id", "taken") == collected(docs, "doc_id", "taken")


def test_empty(spark, tmp_path):
    empty(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_stage(spark, tmp_path):
    """Copies with 22 percent of text put after or before them: similarity 0.82 for five words."""
    rng = random.Random(21)
    texts = [prose(rng, 200, 5000) for _ in range(6)]
    copies = [f"{t} {prose(rng, 44, 5000)}" if k % 2 else f"{prose(rng, 44, 5000)} {t}" for k, t in enumerate(texts)]
    far = [f"{t} {prose(rng, 60, 5000)}" for t in [prose(rng, 200, 5000)]] + [prose(rng, 200, 5000)]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts + copies + far)], DOCUMENTS)
    assert collected(corpus_pipeline.near(spark, docs, str(tmp_path)), "doc_id") == sorted([(k,) for k in (0, 1, 2, 3, 4, 5, 12, 13)], key=repr)

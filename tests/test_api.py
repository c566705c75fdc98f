import json

import pytest
from pyspark.sql import functions as F

from textloom.config import EngineConfig
from textloom.engine import SearchEngine, mine
from textloom.operators import evaluate
from textloom.plans.query import SearchRequest
from textloom.sources import corpus
from textloom.streaming import clicks


def put(folder, files):
    folder.mkdir()
    for name, text in files.items():
        (folder / name).write_text(text)
    return str(folder)


def test_config():
    text = "# comment\n" + "\n".join(f"{k}: x" for k in ("corpus_prefix", "index_prefix", "log_prefix", "corpus_analyzer_type", "log_miner_type")) + "\nindexer_type: fullscan\nstopwords_n: 50\n"
    assert EngineConfig.parse(text).stopwords_n == 50
    for wrong in ("corpus_prefix: x", text + "no colon", text.replace("fullscan", "other")):
        with pytest.raises(ValueError):
            EngineConfig.parse(wrong)


def test_corpus_directory(spark, tmp_path):
    path = put(tmp_path / "c", {"10": "ten", "9": "nine\nlines", "b": "bee", ".x": "hidden"})
    got = [(r["doc_id"], r["url"], r["text"]) for r in corpus.corpus_directory(spark, path).orderBy("doc_id").collect()]
    assert got == [(0, "9", "nine\nlines"), (1, "10", "ten"), (2, "b", "bee")]


def test_files(spark, tmp_path):
    path = put(tmp_path / "f", {"corpus.tsv": 'T "q\tbody text\t7\n', "views": "en A 3\nen B\nfr C x\n", "qrels": "q\t1\tGood\t\nq\t1\tBad\nq\t2\tGood\n", "run": "q\t5\nq\t3\n", "aol": "AnonID\tQuery\tT\tR\tURL\n1\tq\tt\t1\thttp://a\n2\tq\tt\t1\thttp://a\n3\tq\tt\n"})
    assert corpus.corpus_tsv(spark, f"{path}/corpus.tsv").first() == ('T "q', "body text", 7)
    assert corpus.view_log(spark, f"{path}/views").count() == 2
    assert {(r["doc_id"], r["gain"]) for r in evaluate.judgements(corpus.qrels(spark, f"{path}/qrels")).collect()} == {(1, 0.0), (2, 5.0)}
    assert [(r["rank"], r["doc_id"]) for r in corpus.run_files(spark, f"{path}/run").orderBy("rank").collect()] == [(1, 5), (2, 3)]
    assert [r["url"] for r in corpus.clicked_urls(spark, f"{path}/aol").collect()] == ["http://a"]
    ranks = spark.createDataFrame([("A", 0.5)], "name string, value double")
    for text in (False, True):
        corpus.write_ranks(ranks, f"{path}/ranks{text}", text)
        assert corpus.read_ranks(spark, f"{path}/ranks{text}", text).collect() == ranks.collect()
    corpus.write_runs(spark.createDataFrame([("q", 1, 5), ("q", 2, 3), ("p", 1, 1)], "query string, rank int, doc_id long"), f"{path}/out")
    assert spark.read.text(f"{path}/out", recursiveFileLookup=True).count() == 3


def test_click_stream(spark, tmp_path):
    rows = [("s", "q", "1", "go", 0), ("s", "q", "2", "go", 30_000), ("s", "q", "1", "go", 200_000), ("t", "q", "1", "go", 4_000_000)]
    corpus.append_clicks(spark.createDataFrame(rows, corpus.CLICKS), f"{tmp_path}/clicks")
    assert corpus.read_clicks(spark, f"{tmp_path}/clicks").count() == 4
    for name, make in (("sessions", clicks.sessions), ("windows", clicks.clicks_per_window)):
        q = make(clicks.click_stream(spark, f"{tmp_path}/clicks")).writeStream.outputMode("append").format("memory").queryName(name).start()
        q.processAllAvailable()
        q.stop()
    assert sorted(r["clicks"] for r in spark.table("sessions").collect()) == [1, 2]
    assert spark.table("windows").agg(F.sum("clicks")).first()[0] == 3


def test_engine(spark):
    docs = spark.createDataFrame([(0, "red hat and cat", "One", "a/b/c/d/e/f"), (1, "red cat", "Two", "u"), (2, "blue sky and sea", "Three", "v")], "doc_id long, text string, title string, url string")
    signals = spark.createDataFrame([(0, 0.1, 5)], "doc_id long, page_rank double, views long")
    log = spark.createDataFrame([("red hat", 2), ("red cat", 1)], "query string, cnt long")
    engine = SearchEngine.build(docs, signals, log, EngineConfig(stopwords_n=0))
    assert [r["doc_id"] for r in engine.search([(1, "red cat")]).orderBy("rank").collect()] == [1, 0]
    assert engine.prf([(1, "red")], terms=2).count() == 2 and engine.prf_search([(1, "hat")]).count() >= 1
    assert [r["suggestion"] for r in engine.suggest("red").orderBy("rank").collect()] == [" hat", " cat"]
    judged = spark.createDataFrame([(1, 1, 5.0)], "query int, doc_id long, gain double")
    assert engine.evaluate([(1, "red cat")], judged).first()["p_1"] == 1
    assert "a/b/c/.../e/f" in engine.respond(SearchRequest("hat", format="html"))
    assert json.loads(engine.respond(SearchRequest("hat", format="json")))["results"][0]["id"] == 0
    assert engine.respond(SearchRequest("hat")).startswith("0\tOne\t") and engine.respond(SearchRequest("nothing")) == ""


def test_mining(spark):
    pages = spark.createDataFrame([("A", '<a href="B">B</a>'), ("B", ""), ("R", '<meta http-equiv="refresh" content="0;url=B">')], "url string, html string")
    log = spark.createDataFrame([("R", "3"), ("A", "1")], "article string, views string")
    assert sorted((r["url"], r["views"]) for r in mine(pages, log).collect()) == [("A", 1), ("B", 3)]


def test_endpoints(spark, tmp_path):
    pages = spark.createDataFrame([(0, "a", "<title>One</title><p>Red Köln hats, U.K. <b>running</b></p>"), (1, "b", "<script>red</script><p>blue cats</p>")], "doc_id long, url string, html string")
    log = spark.createDataFrame([("red hat", 2), ("red cat", 1)], "query string, cnt long")
    engine = SearchEngine.from_pages(pages, None, log, EngineConfig(stopwords_n=0, analyzer="full"))
    assert [r["doc_id"] for r in engine.search([(1, "koln RUN hat"), (2, '"uk run"')]).collect()] == [0, 0]
    assert engine.search([(1, "script")]).count() == 0
    assert set(engine.prf_lines(SearchRequest("hats", results=1, terms=2)).split()) >= {"0.5"}
    assert engine.document("a")[0] == 200 and engine.document("zz") == (302, "https://en.wikipedia.org/wiki/zz")
    assert json.loads(engine.instant("red"))["results"] == [" hat", " cat"] and engine.known
    assert engine.suggestion_latency(["red", "blue"]) > 0
    assert engine.write_runs(["koln", "cats"], f"{tmp_path}/runs") > 0
    assert corpus.run_files(spark, f"{tmp_path}/runs/*").count() == 2
    engine.clicked(spark.createDataFrame([("s", None, "1", "go", 5)], corpus.CLICKS), f"{tmp_path}/clicks")
    assert corpus.read_clicks(spark, f"{tmp_path}/clicks").first()["query"] == "ERROR"
    doconly = SearchEngine.build(spark.createDataFrame([(0, "b a")], "doc_id long, text string"), config=EngineConfig(stopwords_n=0, indexer_type="inverted-doconly"))
    assert doconly.search([(1, '"a b"')]).count() == 1

import math

import pytest
from pyspark.sql import functions as F

from textloom.operators import autocomplete, evaluate, feedback, graph, index, logs, rank, retrieve, stats
from textloom.plans.query import SearchRequest, parse_query, query_tables

DOCS = "doc_id long, text string"


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_positional_postings(spark):
    texts = {88807: "1 2 1 2 1 2 6 234 8 767 3 9 8", 88812: "6 7 7 3 6 7 1 6"}
    toks = spark.createDataFrame([(d, p, t) for d, x in texts.items() for p, t in enumerate(x.split())], "doc_id long, pos int, term string")
    got = {(r["term"], r["doc_id"]): (r["tf"], r["positions"]) for r in index.positional_postings(toks).collect()}
    want = {("1", 88807): (3, [0, 2, 4]), ("1", 88812): (1, [6]), ("2", 88807): (3, [1, 3, 5]), ("3", 88807): (1, [10]), ("3", 88812): (1, [3]), ("6", 88807): (1, [6]), ("6", 88812): (3, [0, 4, 7]), ("7", 88812): (3, [1, 2, 5]), ("8", 88807): (2, [8, 12])}
    assert want.items() <= got.items()


def test_merge(spark):
    a = spark.createDataFrame([(10, [1, 2, 3, 4, 8]), (20, [5, 6, 9]), (30, [7, 8, 9])], "term int, items array<int>")
    b = spark.createDataFrame([(15, [11, 12, 13, 14, 18]), (20, [25, 26, 29]), (25, [37, 38, 39])], "term int, items array<int>")
    got = {r["term"]: r["items"] for r in index.merge_postings([a, b]).collect()}
    assert got == {10: [1, 2, 3, 4, 8], 15: [11, 12, 13, 14, 18], 20: [5, 6, 9, 25, 26, 29], 25: [37, 38, 39], 30: [7, 8, 9]}


def test_save_and_load(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, None)], DOCS)
    index.Index.build(docs, 1).save(f"{tmp_path}/ix")
    ix = index.Index.load(spark, f"{tmp_path}/ix", 1)
    assert (ix.n_docs, ix.n_tokens) == (3, 5) and rows(ix.stops, "term") == [("a",)]


@pytest.fixture(scope="module")
def small(spark):
    docs = [(0, "the cat sat on the mat"), (1, "the dog sat on the cat"), (2, "the bird the sky"), (3, "cat cat dog"), (4, "on the mat the cat sat"), (5, None)]
    return index.Index.build(spark.createDataFrame(docs, DOCS), 1)


@pytest.mark.parametrize(
    "text, want", {"cat": [0, 1, 3, 4], "cat sat": [0, 1, 4], "the cat": [0, 1, 3, 4], "the": [], '"the cat"': [1, 4, 0], '"cat sat"': [0, 4], '"sat on" mat': [0], "unknown cat": [], '""': [], 'mat "the cat': [0, 4]}.items()
)
def test_matching(spark, small, text, want):
    got = retrieve.match_all(small, *query_tables(spark, [(7, text)]))
    assert rows(got, "doc_id") == sorted((d,) for d in want)


def test_any(spark, small):
    assert rows(retrieve.match_any(small, query_tables(spark, [(1, "the dog bird")])[0]), "doc_id") == [(1,), (2,), (3,)]


def test_cosine_by_hand(spark, small):
    terms, phrases = query_tables(spark, [(1, "the cat sat")])
    got = {r["doc_id"]: r["score"] for r in rank.cosine(small, terms, retrieve.match_all(small, terms, phrases)).collect()}
    texts = {0: "the cat sat on the mat", 1: "the dog sat on the cat", 4: "on the mat the cat sat"}
    df = {"the": 4, "cat": 4, "sat": 3, "on": 3, "mat": 2, "dog": 2}
    idf = {t: 1 + math.log2(6 / n) for t, n in df.items()}
    for d, text in texts.items():
        w = text.split()
        norm = sum((w.count(t) * idf[t]) ** 2 for t in set(w))
        dot = sum(idf[t] ** 2 * w.count(t) for t in ("cat", "sat"))
        assert got[d] == pytest.approx(dot / math.sqrt(norm * sum(idf[t] ** 2 for t in ("the", "cat", "sat"))))


def test_likelihood_by_hand(spark, small):
    terms, phrases = query_tables(spark, [(1, "the cat")])
    got = {r["doc_id"]: r["score"] for r in rank.query_likelihood(small, terms, retrieve.match_all(small, terms, phrases)).collect()}
    assert got[3] == pytest.approx(math.log(0.5 * 8 / 25) + math.log(0.5 * 2 / 3 + 0.5 * 5 / 25))


def test_rankers(spark, small):
    signals = spark.createDataFrame([(0, 0.01, 100), (1, 0.001, 400000)], "doc_id long, page_rank double, views long")
    terms, phrases = query_tables(spark, [(1, "cat")])
    for name in rank.RANKERS:
        best = rank.search(small, terms, phrases, name, 3, signals).collect()
        assert [r["rank"] for r in best] == [1, 2, 3]
    assert rank.search(small, terms, phrases, "numviews", 1, signals).first()["doc_id"] == 1
    assert rank.batch(small, terms, phrases, ["cosine", "ql"], 2).count() == 4
    for wrong in ("phrase", "none"):
        with pytest.raises(ValueError):
            rank.ranker(wrong)
    near = spark.createDataFrame([(1, "the", "cat")], "query_id int, first string, second string")
    assert rows(rank.bigram_rank(small, near), "doc_id", "score") == [(0, 1.0), (1, 1.0), (4, 1.0)]
    assert rank.combined_rank(small, terms, retrieve.match_all(small, terms, phrases), near, signals).count() == 4


def test_feedback(spark, small):
    terms, phrases = query_tables(spark, [(1, "dog")])
    got = feedback.expansion_terms(small, rank.search(small, terms, phrases, "cosine", 2), 2)
    assert rows(got, "term", "count", "prob") == [("cat", 3, 0.6), ("dog", 2, 0.4)]
    assert feedback.expand_query('"dog', [("cat", 0.6), ("do", 0.3), ("x", 0.01)]) == " dog cat"
    assert feedback.expand_query('"Red" Hat', [("red", 0.5), ("hat", 0.3), ("cap", 0.2)]) == " red  hat cap"
    assert rows(feedback.expanded_search(spark, small, [(1, "dog")]), "doc_id") == [(1,)]  # dog cat on sat
    d = spark.createDataFrame([("a", "x", 0.5), ("a", "y", 0.5), ("b", "x", 1.0), ("c", "z", 1.0)], "query_id string, term string, prob double")
    sim = {(r["query_a"], r["query_b"]): r["similarity"] for r in feedback.bhattacharyya(d).collect()}
    assert len(sim) == 6 and sim["a", "b"] == sim["b", "a"] == pytest.approx(math.sqrt(0.5)) and sim["a", "c"] == 0


def test_query_parsing():
    assert parse_query('a "b c" d').phrases == {"b c": ["b", "c"]} and parse_query('a "b c" d').tokens == ["a", "d"]
    assert parse_query('a b "c d').tokens == ["a", "b"] and parse_query('a b "c d').phrases == {"c d": ["c", "d"]}
    r = SearchRequest.from_url("query=red+hat&num=7&ranker=QL&format=json&numterms=x")
    assert (r.query, r.results, r.ranker, r.format, r.terms) == ("red hat", 7, "ql", "json", 10)


PAGES = "url string, html string"
FOUR = [("A", '<a href="B" title="t">B</a>\n<a href="C">C</a>\n<a href="D">D</a>'), ("B", '<a href="C">C</a>\n<a href="D">D</a>'), ("C", '<a href="A">A</a>'), ("D", '<a href="A">A</a>\n<a href="C">C</a>')]


def test_pagerank(spark):
    got = {r["node"]: r["page_rank"] for r in graph.pagerank(*graph.build_graph(spark.createDataFrame(FOUR, PAGES))).collect()}
    assert got == pytest.approx({"A": 0.413125, "B": 0.13375, "C": 0.274375, "D": 0.17875})


def test_graph_edges(spark):
    more = [
        ("E", '<a href="A">1</a> <a href="A">2</a>\n<a href="E">self</a>\n<a href="x/y">no</a><a href="#z">no</a>\n<a href="R">r</a>\n<a href="X">x</a>'),
        ("R", '<meta http-equiv="refresh" content="0;url=S">'),
        ("S", '<meta http-equiv="refresh" content="0;url=B">'),
        ("X", '<meta http-equiv="refresh" content="0;url=Y">'),
        ("Y", '<meta http-equiv="refresh" content="0;url=X">'),
        ("Z", None),
    ]
    pages = spark.createDataFrame(FOUR + more, PAGES)
    nodes, edges = graph.build_graph(pages)
    assert rows(nodes, "node") == [(x,) for x in "ABCDEZ"]
    assert rows(edges.where("src = 'E'"), "dst") == [("A",), ("A",), ("B",), ("E",)]
    assert rows(graph.close_redirects(graph.redirects(pages)), "url", "target") == [("R", "B"), ("S", "B")]
    ranks = {r["node"]: r["page_rank"] for r in graph.pagerank(nodes, edges, iterations=12).collect()}
    assert set(ranks) == set("ABCDEZ") and sum(ranks.values()) < 1


def test_long_redirects(spark):
    """A chain of any length is followed; a cycle and what leads to it are dropped; of two targets the smaller counts."""
    moves = [(f"r{k}", f"r{k + 1}") for k in range(40)] + [("r0", "zzz"), ("x", "y"), ("y", "x"), ("w", "x")]
    got = graph.close_redirects(spark.createDataFrame(moves, "url string, target string"))
    assert rows(got, "url", "target") == sorted((f"r{k}", "r40") for k in range(40))
    assert graph.close_redirects(spark.createDataFrame([], "url string, target string")).count() == 0


def test_view_counts(spark):
    log = spark.createDataFrame([("A", "3"), ("A", "x"), ("R", "2"), ("Q", "9"), ("T", "4")], "article string, views string")
    corpus = spark.createDataFrame([("A",), ("B",), ("R",), ("T",), ("T2.html",)], "url string")
    moves = spark.createDataFrame([("R", "A"), ("T", "T2")], "url string, target string")
    assert rows(logs.view_counts(log, corpus, moves), "url", "views") == [("A", 5), ("B", 0), ("T2.html", 4)]
    click = logs.click_record(spark.createDataFrame([("s", None, "1", "go", 5)], "session string, query string, doc_id string, action string, ts_ms long")).first()
    assert click["query"] == "ERROR" and click["ts_ms"] == 5


def test_ranks_and_spearman(spark):
    pr = spark.createDataFrame([("A", 0.41312504), ("B", 0.13374999), ("C", 0.274375), ("D", 0.17875001), ("E", 0.323422)], "key string, value double")
    nv = spark.createDataFrame([("A", 4), ("C", 2), ("B", 1), ("E", 2), ("D", 0)], "key string, value long")
    assert [r[1] for r in rows(stats.rank_with_ties(pr), "key", "rank")] == [1, 5, 3, 4, 2]
    assert [r[1] for r in rows(stats.rank_with_ties(nv), "key", "rank")] == [1, 4, 2.5, 5, 2.5]
    assert [r[1] for r in rows(stats.rank_without_ties(nv), "key", "rank")] == [1, 4, 2, 5, 3]
    assert stats.spearman(pr, nv).first()["rho"] == pytest.approx(0.872081599272381)
    assert stats.equal_keys(pr, nv).count() == 5
    with pytest.raises(ValueError):
        stats.equal_keys(pr, nv.where("key != 'A'"))


def test_ranks_in_ranges(spark):
    values = spark.range(1000).selectExpr("id AS key", "id % 37 AS value")
    want = sorted(((v, k) for k, v in ((k, k % 37) for k in range(1000))), key=lambda x: (-x[0], x[1]))
    assert rows(stats.rank_without_ties(values), "key", "rank") == sorted((k, n + 1) for n, (_, k) in enumerate(want))
    assert stats.rank_with_ties(values.where("key < 0")).count() == 0


def test_plain_rankers(spark, small):
    terms, _ = query_tables(spark, [(1, "the zzz"), (2, "cat")])
    got = {(r["query_id"], r["doc_id"]): r["score"] for r in rank.plain_cosine(small, terms).collect()}
    assert len(got) == 12 and got[1, 3] == got[1, 5] == got[2, 2] == 0 and got[1, 0] > 0
    likely = {(r["query_id"], r["doc_id"]): r["score"] for r in rank.plain_likelihood(small, terms).collect()}
    assert likely[2, 3] == pytest.approx(math.log(0.5 * 2 / 3 + 0.5 * 5 / 25)) and likely[2, 5] == pytest.approx(math.log(0.5 * 5 / 25))


def test_histograms(spark):
    pr = spark.createDataFrame([(0.01,), (0.005,), (1e-6,), (0.5,)], "value double")
    assert rows(stats.pagerank_histogram(pr), "decade", "n", "percent") == [(-6, 1, 25.0), (-3, 1, 25.0), (-2, 1, 25.0)]
    nv = spark.createDataFrame([(0,), (9,), (10,), (5_000_000,)], "value long")
    assert rows(stats.views_histogram(nv), "decade", "n") == [(0, 2), (1, 1)]


def test_suggestions(spark, tmp_path):
    lines = spark.createDataFrame([("red hat\t5",), ("red bag\t5",), ("red, cap!\t3",), ("red cap",), ("redo\t9",), ("blue",)], "value string")
    log = autocomplete.consolidate(autocomplete.clean_log(lines))
    assert rows(autocomplete.suggest(log, "red"), "rank", "suggestion", "cnt") == [(1, "o", 9), (2, " bag", 5), (3, " cap", 4)]
    assert autocomplete.suggest(log, "red", collapse_ties=False).count() == 4
    assert autocomplete.suggest(log, "re").count() == autocomplete.suggest(log, "zzz").count() == 0
    autocomplete.prepare(log, f"{tmp_path}/log")
    autocomplete.record(spark.createDataFrame([("new--one",)], "query string"), f"{tmp_path}/log")
    assert spark.read.parquet(f"{tmp_path}/log").where("query = 'new one'").count() == 1


GOLDEN = {
    "google": ([5, 0, 5, 0, 0, 0, 5, 0, 5, 0], (1, 0.4, 0.4), (0.25, 0.5, 1), (0.4, 0.444444, 0.571429), 0.634921, (1, 0.815465, 0.735437), 1),
    "bing": ([5, 0, 0, 0, 0, 0, 5, 0, 0, 0], (1, 0.2, 0.2), (0.5, 0.5, 1), (0.666667, 0.285714, 0.333333), 0.642857, (1, 1, 0.678104), 1),
    "fox news": ([5, 5, 0, 0, 5, 0, 5, 5, 0, 0], (1, 0.6, 0.5), (0.2, 0.6, 1), (0.333333, 0.6, 0.666667), 0.759286, (1, 0.923885, 0.87607), 1),
    "soccer": ([5, 5, 5, 5, 5, 0, 5, 0, 0, 0], (1, 1, 0.6), (0.166667, 0.833333, 1), (0.285714, 0.909091, 0.75), 0.97619, (1, 1, 0.992239), 1),
    "dictionary": ([5] * 10, (1, 1, 1), (0.1, 0.5, 1), (0.181818, 0.666667, 1), 1, (1, 1, 1), 1),
    "cnn": ([0] * 10, (0, 0, 0), (0, 0, 0), (0, 0, 0), 0, (0, 0, 0), 0),
}


def test_retrieval_figures(spark):
    run = spark.createDataFrame([(q, i + 1, i) for q, g in GOLDEN.items() for i in range(10)] + [("unjudged", 1, 1)], "query string, rank int, doc_id long")
    grades = spark.createDataFrame([(q, i, "good" if x else "Bad", 2) for q, g in GOLDEN.items() for i, x in enumerate(g[0])] + [("google", 1, "Good", 1)], "query string, doc_id long, grade string, line int")
    judged = evaluate.judgements(grades)
    got = {r["query"]: r for r in evaluate.report(run, judged).collect()}
    assert set(got) == set(GOLDEN)
    for q, (_, p, r, f, ap, ndcg, rr) in GOLDEN.items():
        for k, *want in zip((1, 5, 10), p, r, f, ndcg):
            assert [got[q][f"{x}_{k}"] for x in ("p", "r", "f", "ndcg")] == pytest.approx(want, abs=1e-6)
        assert (got[q]["ap"], got[q]["rr"]) == pytest.approx((ap, rr), abs=1e-6)
    assert got["google"]["ip_0"] == 1 and got["google"]["ip_10"] == pytest.approx(4 / 9)
    assert evaluate.summary(run, judged).first()["map"] == pytest.approx(sum(g[4] for g in GOLDEN.values()) / 6, abs=1e-6)
    assert rows(evaluate.recall_at(evaluate.judged_run(run, judged), (1,), judged).where("query = 'google'"), "r_1") == [(0.25,)]
    assert {r["gain"] for r in evaluate.judgements(grades, True).collect()} == {0.0}

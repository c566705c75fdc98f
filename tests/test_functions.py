import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.functions import analysis as A
from textloom.functions import codec as C
from textloom.functions.stemming import stem

STEMS = {
    "caresses": "caress", "ponies": "poni", "ties": "ti", "caress": "caress", "cats": "cat", "feed": "feed", "agreed": "agree", "disabled": "disable", "matting": "mat",
    "mating": "mate", "meeting": "meet", "milling": "mill", "messing": "mess", "meetings": "meet", "happy": "happy", "is": "is", "hopping": "hop", "filing": "file", "this": "thi",
}


@pytest.mark.parametrize("word, want", STEMS.items())
def test_first_step(word, want):
    assert stem(word) == want


@pytest.mark.parametrize("word, want", {"happy": "happi", "relational": "relat", "hopefulness": "hope", "adjustment": "adjust", "controlling": "control", "electriciti": "electr"}.items())
def test_all_steps(word, want):
    assert stem(word, True) == want


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "t string").select(make(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize("text, want", {"I.B.M. and U.K.": "IBM and UK", "u k": "uk", "in u k now": "in uk now"}.items())
def test_initials(spark, text, want):
    assert one(spark, text, A.remove_initials_dots) == want


def test_folding(spark):
    assert one(spark, "Crème brûlée 日", A.fold) == "Creme brulee  U26085 "
    assert one(spark, None, A.fold) is None


def test_plain_terms(spark):
    assert one(spark, "A b-C\nçd", A.plain_terms) == ["a", "b", "c", "d"]
    assert one(spark, None, A.plain_terms) == []


def test_full_tokens(spark):
    docs = spark.createDataFrame([(1, "The U.K. ponies, ÉTÉ 日"), (2, None)], "doc_id long, text string")
    got = sorted((r["pos"], r["term"]) for r in A.full_tokens(docs).collect())
    assert got == [(0, "the"), (1, "uk"), (2, "poni"), (3, "ete"), (4, "u26085")]


def test_markup(spark):
    page = "<html><head><title>A &amp; B</title></head><body><!-- no --><script>x</script><p>Hi&nbsp;<b>you</b></p></body></html>"
    assert one(spark, page, A.strip_markup).split() == ["Hi", "you"]
    assert one(spark, page, A.page_title) == "A &amp; B"


@pytest.mark.parametrize("url, want", {"a/b/c/d/e/f": "a/b/c/.../e/f", "a/b": "a/b"}.items())
def test_short_url(spark, url, want):
    assert one(spark, url, A.short_url) == want


def test_clean_log_query(spark):
    assert one(spark, "--red, Plate!!", A.clean_log_query) == " red Plate"


def test_known_names(spark):
    known = spark.createDataFrame([("a",), ("b",)], "name string")
    assert [r["name"] for r in A.known_names(spark.createDataFrame([("a",), ("z",)], "name string"), known).collect()] == ["a"]


@pytest.mark.parametrize("value, size", [(0, 1), (127, 1), (128, 2), (16383, 2), (16384, 3), (2097151, 3), (2097152, 4), (268435455, 4)])
def test_code_sizes(spark, value, size):
    assert len(C.encode(value)) == size
    assert one(spark, str(value), lambda c: C.vbyte_length(c.cast("long"))) == size


def test_code_bytes():
    assert C.encode(1) == b"\x81" and C.encode(128) == b"\x01\x80" and C.encode(0) == b"\x80"
    with pytest.raises(ValueError):
        C.encode(-1)


@given(st.lists(st.integers(0, 2**40)))
def test_code_round_trip(values):
    assert C.decode(b"".join(map(C.encode, values))) == values


@given(st.integers(-(2**31), 2**31 - 1))
def test_int_bytes(value):
    assert C.bytes_to_int(C.int_to_bytes(value)) == value


def test_column_codes_and_gaps(spark):
    rows = spark.createDataFrame([("a", 5, 2, [0, 7]), ("a", 9, 1, [3]), ("b", 2, 1, [1])], "term string, doc_id long, tf int, positions array<int>")
    coded = C.delta_postings(rows)
    assert sorted((r["term"], r["doc_gap"], r["gaps"]) for r in coded.collect()) == [("a", 4, [3]), ("a", 5, [0, 7]), ("b", 2, [1])]
    assert sorted(map(tuple, C.undelta_postings(coded.drop("doc_id")).collect())) == sorted(map(tuple, rows.collect()))
    assert rows.select(C.vbyte_decode(C.vbyte_encode("positions")).alias("x")).first()["x"] == [0, 7]

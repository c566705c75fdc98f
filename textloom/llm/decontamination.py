"""Benchmark decontamination: short test items found inside long documents.

Texts are lower-cased, stripped of all but letters, digits and word breaks, and
cut into five-word shingles (an item of fewer words is one shingle).  An item
is in a document if at least 80 % of its distinct shingles are.

Search: items are partitioned by size, in powers of two of their shingle
number, and each keeps the shingles with the smallest hashes as its MinHash
sketch: one more than may be missing at the partition's upper size.  A
document that contains an item therefore holds at least one value of its
sketch, whatever the document's length, and the search loses nothing.  The
sketches are broadcast while they have at most ``BROADCAST_ROWS`` rows, else
joined by shuffle.  Verification counts the shingles themselves, as text.

Defined results: null and empty texts and items match nothing; rows with equal
doc_id and text are one document; equal items each get their rows; empty
tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

SHINGLE = 5
MISSING_PERCENT = 20
BROADCAST_ROWS = 200_000
DOC, KEY = "__leak_doc", "__leak_key"


def normal_words(text: str = "text") -> Column:
    plain = F.regexp_replace(F.lower(text_or_empty(text)), r"[^\p{L}\p{N}\x20\x09-\x0D]", "")
    return F.filter(F.split(plain, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _shingles(k: int, hashed: bool, words: str = "words") -> str:
    one = ", ".join(f"{words}[i + {j}]" for j in range(k))
    one = f"xxhash64({one})" if hashed else f"concat_ws(' ', {one})"
    return f"CASE WHEN size({words}) >= {k} THEN transform(sequence(0, size({words}) - {k}), i -> {one}) ELSE CAST(array() AS array<{'bigint' if hashed else 'string'}>) END"


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """``item_id, k, shingles, sketch`` of every item that has a word; equal rows count once."""
    words = benchmark.select(F.col("item_id").cast("long").alias("item_id"), normal_words().alias("words")).where("size(words) > 0").distinct()
    by_size = " ".join(f"WHEN size(words) = {k} THEN {{{k}}}" for k in range(1, SHINGLE))
    both = {}
    for hashed in (False, True):
        cases = by_size.format(*([None] + [f"({_shingles(k, hashed)})" for k in range(1, SHINGLE)]))
        both[hashed] = F.expr(f"array_distinct(CASE {cases} ELSE ({_shingles(SHINGLE, hashed)}) END)")
    upper = "shiftleft(1L, CAST(ceil(log2(size(hashes))) AS INT))"
    return (
        words.select("item_id", F.expr(f"least(size(words), {SHINGLE})").alias("k"), both[False].alias("shingles"), both[True].alias("hashes"))
        .selectExpr("item_id", "k", "shingles", f"slice(array_sort(hashes), 1, CAST({MISSING_PERCENT} * {upper} DIV 100 + 1 AS INT)) AS sketch")
    )


def find_items(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, n_item, n_found, containment`` of each item in each document, with the text's key."""
    items = benchmark_items(benchmark)
    sketch = items.select("item_id", "k", F.explode("sketch").alias("h"))
    rows, ks = sketch.agg(F.count("*"), F.sort_array(F.collect_set("k"))).first()
    sketch = sketch.drop("k")
    keyed = docs.select(F.col("doc_id").cast("long").alias(DOC), F.xxhash64("text").alias(KEY), "text")

    hashes = f"concat({', '.join(_shingles(k, True) for k in ks or [SHINGLE])})"
    searched = keyed.select(DOC, KEY, normal_words().alias("words")).selectExpr(DOC, KEY, f"explode({hashes}) AS h")
    hits = searched.join(F.broadcast(sketch), "h") if rows <= BROADCAST_ROWS else searched.distinct().join(sketch, "h")
    pairs = hits.select(DOC, KEY, "item_id").distinct()

    whole = items.select(F.col("item_id").alias("of_item"), "k", "shingles")
    named = pairs.join(whole, F.expr("item_id <=> of_item")).groupBy(DOC, KEY).agg(F.collect_list(F.struct("item_id", "k", "shingles")).alias("items"))
    named = named.toDF("at_doc", "at_key", "items")
    once = keyed.join(named, F.expr(f"{DOC} <=> at_doc AND {KEY} = at_key")).select(DOC, KEY, "items", normal_words().alias("words"))
    in_doc = " ".join(f"WHEN it.k = {k} THEN all[{n}]" for n, k in enumerate(ks or [SHINGLE]))
    counted = f"""transform(array(array({", ".join(_shingles(k, False) for k in ks or [SHINGLE])})), all -> transform(items, it ->
        named_struct('item_id', it.item_id, 'n_item', CAST(size(it.shingles) AS BIGINT), 'n_found', CAST(size(array_intersect(it.shingles, CASE {in_doc} END)) AS BIGINT))))[0]"""
    return (
        once.selectExpr(DOC, KEY, f"explode({counted}) AS m")
        .selectExpr(f"{DOC} AS doc_id", KEY, "m.*")
        .where(f"100 * n_found >= {100 - MISSING_PERCENT} * n_item")
        .withColumn("containment", F.col("n_found") / F.col("n_item"))
        .distinct()
    )


def without_items(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item."""
    found = find_items(docs, benchmark).select(F.col("doc_id").alias(DOC), KEY).distinct()
    keyed = docs.withColumn("__leak_own", F.xxhash64("text"))
    return keyed.join(found, keyed["doc_id"].eqNullSafe(found[DOC]) & (keyed["__leak_own"] == found[KEY]), "left_anti").drop("__leak_own")

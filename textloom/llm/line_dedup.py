"""Line deduplication by winnowing over line hashes.

Lines that hold a word are hashed.  In every window of ``RUN_LINES``
consecutive lines the smallest hash (the last of equals) is the window's
fingerprint, so any run of that many lines that two places share has a
fingerprint in common.  A line of ``LONG_WORDS`` words or more is a run of its
own and always a fingerprint.

Only the selected lines are exploded and joined, each with the windows that
chose it.  Fingerprints that occur in one place only are dropped by a join
against the places per fingerprint.  At the places that remain, matches are
extended to both sides over the windows that chose the fingerprint, and those
are compared with the first place (smallest doc_id, then position) that has
them, never pair by pair, so a run that thousands of documents share costs one
row for each.  Every line of a run that also starts at an earlier place is
deleted; as each window of a longer run has its fingerprint in that run,
overlapping windows make up runs of any length.

Defined results: a null or empty text has no lines and stays as it is; rows
with equal doc_id and text are one document and get the same result; a null
doc_id comes first; different texts under one doc_id are ordered by their
hash; an empty table gives an empty result; other columns pass through
untouched.  Lines without a word are neither compared nor deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, n_words, stored, text_or_empty

RUN_LINES = 3
LONG_WORDS = 10
#: Names of the key columns, unlikely to clash with those of a table.
DOC, KEY = "__line_doc", "__line_key"


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({DOC: F.col("doc_id").cast("long"), KEY: F.xxhash64("text")})


def fingerprints(docs: DataFrame) -> DataFrame:
    """A row per selected line: its hash ``f``, its place ``p`` among the document's lines, and the windows that chose it.

    ``windows`` holds place, hashes and line numbers of up to ``RUN_LINES`` windows,
    and of the line itself where it is long.
    """
    k, wanted = RUN_LINES, WORD.replace("\\", "\\\\")
    hashed = docs.select(
        DOC,
        KEY,
        F.expr(f"filter(transform(split(coalesce(text, ''), '\\n'), (x, i) -> named_struct('i', i, 'h', xxhash64(x, length(x)), 'w', regexp_count(x, '{wanted}'))), r -> r.w > 0)").alias("rows"),
    )
    inside = ", ".join(f"rows[p + {j}].h" for j in range(k))
    last_min = " ".join(f"WHEN rows[p + {j}].h = least({inside}) THEN p + {j}" for j in reversed(range(k)))
    # The smallest line of each window, by the window's first line; lines without a word are not among the rows.
    minima = f"CASE WHEN size(rows) >= {k} THEN transform(sequence(0, size(rows) - {k}), p -> CASE {last_min} END) ELSE CAST(array() AS array<int>) END"
    long = f"filter(transform(rows, (r, p) -> CASE WHEN r.w >= {LONG_WORDS} THEN p END), p -> p IS NOT NULL)"
    chosen = hashed.select("*", F.expr(minima).alias("minima")).select("*", F.expr(f"explode(array_union(minima, {long}))").alias("at"))
    window = f"named_struct('p', p, 'run', xxhash64({inside}), 'check', hash({inside}), 'lines', transform(slice(rows, p + 1, {k}), r -> r.i))"
    over = f"transform(filter(sequence(greatest(at - {k - 1}, 0), at), p -> p < size(minima) AND minima[p] = at), p -> {window})"
    alone = "named_struct('p', at, 'run', xxhash64(rows[at].h), 'check', hash(rows[at].h), 'lines', array(rows[at].i))"
    return chosen.selectExpr(DOC, KEY, "at", "rows[at].h AS f", f"CASE WHEN rows[at].w >= {LONG_WORDS} THEN array_append({over}, {alone}) ELSE {over} END AS windows")


def lost_lines(docs: DataFrame) -> DataFrame:
    """The numbers of the lines that each document loses, ``gone``; documents that lose none are left out.

    Tables are stored before they are joined: a join then reads plain exchanges, and
    Spark splits the partition of a fingerprint or run that very many places have.
    """
    chosen = stored(fingerprints(docs), "lines-fingerprints")
    place = F.struct(DOC, KEY, "at")
    shared = stored(chosen.groupBy("f").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a != b").select("f"), "lines-shared")
    matched = stored(chosen.join(shared, "f", "left_semi").select(DOC, KEY, F.explode("windows").alias("w")).select(DOC, KEY, "w.*"), "lines-runs")
    place = F.struct(DOC, KEY, "p")
    first = stored(matched.groupBy("run", "check").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first != last").drop("last"), "lines-first")
    later = matched.join(first, ["run", "check"]).where(F.struct(DOC, KEY, "p") > F.col("first"))
    return later.groupBy(DOC, KEY).agg(F.array_distinct(F.flatten(F.collect_list("lines"))).alias("gone"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The documents with later repeated runs cut out of ``text``, and how many lines that took (``lines_removed``)."""
    keyed = _keyed(docs)
    lost = lost_lines(keyed.select(DOC, KEY, "text").where(text_or_empty() != "")).toDF("__lost_doc", "__lost_key", "__gone")
    same = F.expr(f"{DOC} <=> __lost_doc AND {KEY} = __lost_key")
    # The one-element array binds the split lines to a name, else each index would split the text again.
    left = F.expr("transform(array(split(text, '\\n')), ls -> array_join(transform(array_except(sequence(0, size(ls) - 1), __gone), i -> ls[i]), '\\n'))[0]")
    joined = keyed.join(lost, same, "left")
    return joined.select(
        *(F.when(F.col("__gone").isNull(), F.col("text")).otherwise(left).alias("text") if c == "text" else keyed[c] for c in docs.columns),
        F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("lines_removed"),
    )


def dedup_report(docs: DataFrame) -> DataFrame:
    """``doc_id, n_removed, words_left, kept_md5`` of every document."""
    return dedup_lines(docs.select("doc_id", "text")).select("doc_id", F.col("lines_removed").alias("n_removed"), n_words().alias("words_left"), F.md5(text_or_empty()).alias("kept_md5"))

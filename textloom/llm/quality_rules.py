"""Line-first quality rules.

Every line that holds a word is judged on its own by three rules; failing lines
are removed, and a document that loses too much of its text is rejected.

* punctuation: symbol characters (other than ``|``) or exclamation marks are
  at least half as many as the words of the line;
* navigation: the line has at least two ``|``, and one for every five words;
* boilerplate: the line repeats an earlier line of the document, or contains a
  licence or site notice.

Defined results: a null or empty text has no words, fails the base rules and is
not kept; repeated rows are judged alike; an empty table gives an empty result;
extra columns are ignored; the length of a text is not limited (one text is
held in memory at a time).  ``doc_id`` may be null and is passed through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K

#: Notices that mark a line as boilerplate, in lower case.
NOTICES = (
    "licensed under",
    "all rights reserved",
    "terms of service",
    "terms of use",
    "privacy policy",
    "cookie policy",
    "accept cookies",
    "subscribe to our newsletter",
)
SYMBOLS = b"#*$%&|<>"

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, n_lines long, n_bad_punctuation long, n_bad_navigation long, "
    "n_bad_boilerplate long, words_left long"
)


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    max_repeat_percent: int = 50
    #: A document goes when more than this share of its words is on removed lines.
    max_lost_percent: int = 50


def _flags(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


_SYMBOL, _JUNK, _PIPE, _BANG = _flags(SYMBOLS), _flags(SYMBOLS.replace(b"|", b"")), _flags(b"|"), _flags(b"!")
_NOTICE = re.compile("|".join(map(re.escape, NOTICES)).encode())
_ROLL, _CODES, _WORDS = K.Roller(11), K.byte_codes(12), K.Roller(13)


def judge(data: np.ndarray, bounds: np.ndarray, rules: Rules) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Figures of each text of a slice, and of each of its lines."""
    texts = K.Texts(data, bounds)
    prefix = _ROLL.prefix(_CODES[data])
    salt = K.mix(np.arange(texts.n, dtype=np.uint64) + K.U64(1))

    def count(flags: np.ndarray, edges: np.ndarray) -> np.ndarray:
        return K.per_text(flags[data], edges)

    in_words = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~K.IS_BREAK[data] & ((data & 0xC0) != 0x80), out=in_words[1:])

    # Words in three-word windows that the text has twice or more.
    words = _ROLL.ranges(prefix, texts.start, texts.end)
    at, per = texts.windows(3)
    windows = _WORDS.ranges(_WORDS.prefix(words), at, at + 3) + np.repeat(salt, per)
    repeat = K.per_text(K.covered(at[K.repeated(windows)], 3, len(words)), texts.first)

    # Lines: cut after each line feed and at each text's end.
    cuts = np.unique(np.concatenate([bounds, np.flatnonzero(data == 10) + 1]))
    line_start, line_end = cuts[:-1], cuts[1:]
    line_end = line_end - (data[line_end - 1] == 10) if len(line_end) else line_end
    first_word = np.searchsorted(texts.start, cuts)
    line_words = np.diff(first_word)
    owner = np.searchsorted(bounds, line_start, side="right") - 1
    full = line_words > 0
    line_hash = _ROLL.ranges(prefix, line_start, line_end) + salt[owner]
    _, earliest = np.unique(line_hash[full], return_index=True)
    dup = full.copy()
    dup[np.flatnonzero(full)[earliest]] = False

    notice = np.zeros(len(line_start), bool)
    lowered = data.tobytes().lower()
    for m in _NOTICE.finditer(lowered):
        k = np.searchsorted(cuts, m.start(), side="right") - 1
        if m.end() <= cuts[k + 1]:
            notice[k] = True
    pipes = count(_PIPE, cuts)
    bad_punctuation = full & ((2 * count(_JUNK, cuts) >= line_words) | (2 * count(_BANG, cuts) >= line_words))
    bad_navigation = full & (pipes >= 2) & (5 * pipes >= line_words)
    bad_boilerplate = full & (dup | notice)
    bad = bad_punctuation | bad_navigation | bad_boilerplate

    def by_text(x: np.ndarray) -> np.ndarray:
        return np.bincount(owner, weights=x, minlength=texts.n).astype(np.int64)

    n_words = texts.counts.astype(np.int64)
    left = by_text(np.where(bad, 0, line_words))
    failed = (n_words < rules.min_words) | (100 * repeat > rules.max_repeat_percent * n_words)
    per_doc = {
        "n_words": n_words,
        "word_chars": in_words[bounds[1:]] - in_words[bounds[:-1]],
        "n_symbols": count(_SYMBOL, bounds),
        "n_dup_lines": by_text(dup),
        "n_repeat_words": repeat,
        "base_failed": failed,
        "kept": ~failed & (100 * (n_words - left) <= rules.max_lost_percent * n_words),
        "n_lines": by_text(full),
        "n_bad_punctuation": by_text(bad_punctuation),
        "n_bad_navigation": by_text(bad_navigation),
        "n_bad_boilerplate": by_text(bad_boilerplate),
        "words_left": left,
    }
    return per_doc, {"owner": owner, "start": line_start, "end": line_end, "bad": bad}


def quality_rules(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row per document with its figures and the verdict ``kept``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, bounds in K.slices(batch.column("text")):
                figures, _ = judge(data, bounds, rules)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), *map(pa.array, figures.values())], names=["doc_id", *figures])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def clean_lines(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """``doc_id, text, kept``: every document's text without its failing lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, bounds in K.slices(batch.column("text")):
                figures, lines = judge(data, bounds, rules)
                raw, texts = data.tobytes(), [[] for _ in range(b - a)]
                for k in np.flatnonzero(~lines["bad"]):
                    texts[lines["owner"][k]].append(raw[lines["start"][k] : lines["end"][k]])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array([b"\n".join(x).decode() for x in texts]), pa.array(figures["kept"])], names=["doc_id", "text", "kept"]
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, text string, kept boolean")

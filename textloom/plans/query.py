"""Query texts to tables of operands."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from urllib.parse import parse_qs, unquote_plus

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..functions.analysis import plain_query, query_text
from ..functions.stemming import stem


@dataclass
class ParsedQuery:
    text: str
    tokens: list[str] = field(default_factory=list)
    phrases: dict[str, list[str]] = field(default_factory=dict)


@dataclass(frozen=True)
class Analyzer:
    """The query side of an analyzer: what is done to a whole query, and to its parts between quotation marks."""

    normal: Callable[[str], str]
    words: Callable[[str], list[str]]


PLAIN = Analyzer(lambda text: text, plain_query)
#: Without accents, initials' dots and other marks than quotation marks; letters without case as tokens; stems.
FULL = Analyzer(query_text, lambda text: [stem(w) for w in text.split()])


def parse_query(text: str, analyzer: Analyzer = PLAIN) -> ParsedQuery:
    """Tokens outside quotation marks and phrases inside.

    With an odd number of marks, everything after the first is one phrase, and
    the text before it loses its last character.  Equal phrases count once.
    """
    text, words = analyzer.normal(text), analyzer.words
    out = ParsedQuery(text)
    marks = text.count('"')
    if marks % 2 == 0:
        for k, part in enumerate(text.split('"')):
            if k % 2:
                out.phrases[part] = words(part)
            else:
                out.tokens += words(part)
        return out
    before, _, after = text.partition('"')
    out.phrases[after] = words(after)
    out.tokens += words(before[:-1])
    return out


def _local(spark: SparkSession, rows: list[tuple], schema: pa.Schema) -> DataFrame:
    """A table that the optimizer knows the rows of: an empty one cuts the joins with it out of a plan."""
    columns = list(zip(*rows)) or [[] for _ in schema]
    return spark.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema))


TERMS = pa.schema([("query_id", pa.int32()), ("term", pa.string()), ("qtf", pa.int64()), ("token_tf", pa.int64())])
PHRASES = pa.schema([("query_id", pa.int32()), ("phrase_id", pa.int32()), ("offset", pa.int32()), ("term", pa.string())])


def query_tables(spark: SparkSession, queries: list[tuple[int, str]], analyzer: Analyzer = PLAIN) -> tuple[DataFrame, DataFrame]:
    """``query_id, term, qtf, token_tf`` (token_tf: outside phrases) and ``query_id, phrase_id, offset, term``."""
    terms, phrases = [], []
    for query_id, text in queries:
        parsed = parse_query(text, analyzer)
        counts: dict[str, list[int]] = {}
        for t in parsed.tokens:
            counts.setdefault(t, [0, 0])
            counts[t] = [counts[t][0] + 1, counts[t][1] + 1]
        for k, phrase in enumerate(parsed.phrases.values()):
            for offset, t in enumerate(phrase):
                counts.setdefault(t, [0, 0])[0] += 1
                phrases.append((query_id, k, offset, t))
        terms += [(query_id, t, a, b) for t, (a, b) in counts.items()]
    return _local(spark, terms, TERMS), _local(spark, phrases, PHRASES)


@dataclass
class SearchRequest:
    """What a search asks for; values that cannot be read keep their defaults."""

    query: str = ""
    ranker: str = "cosine"
    results: int = 10
    format: str = "text"
    terms: int = 10

    @classmethod
    def from_url(cls, url_query: str) -> SearchRequest:
        got = {k: v[-1] for k, v in parse_qs(url_query, keep_blank_values=True).items()}
        out = cls(query=unquote_plus(got.get("query", "")), ranker=got.get("ranker", "cosine").lower())
        for key, name in (("num", "results"), ("numdocs", "results"), ("numterms", "terms")):
            if got.get(key, "").isdigit():
                setattr(out, name, int(got[key]))
        if got.get("format", "").lower() in ("text", "html", "json"):
            out.format = got["format"].lower()
        return out

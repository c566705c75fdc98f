"""Text to terms.

Two analyzers share their shape.  ``plain_terms`` lower-cases and takes runs of
``a-z0-9``.  ``full_tokens`` adds, before that, the removal of initials' dots,
accents and scripts without case, and the stemmer's first step after, all in
built-in expressions; only texts with letters without case (whose code points
become tokens) go through an Arrow function, and the stemmer's later steps run
as one over distinct words.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stemming import stem

#: The patterns for initials, in the order of application.
DOTTED_INITIAL = r"(?i)(^([a-z])\.|(?<= )([a-z])\.|(?<=\.)([a-z])\.)"
PAIR_AT_START = r"(?i)^(([a-z]) ([a-z]))($| )"
PAIR_AFTER_SPACE = r"(?i)(?<= )(([a-z]) ([a-z]))($| )"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def plain_terms(text: str | Column = "text") -> Column:
    """Terms in order, a null text has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(_col(text), F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def remove_initials_dots(text: str | Column) -> Column:
    """``U.K.`` to ``UK``; two single letters in a row become one word."""
    out = F.trim(F.regexp_replace(_col(text), DOTTED_INITIAL, "$2$3$4"))
    out = F.trim(F.regexp_replace(out, PAIR_AT_START, "$2$3 "))
    return F.trim(F.regexp_replace(out, PAIR_AFTER_SPACE, "$2$3 "))


def fold_text(text: str) -> str:
    """Without combining marks; letters without case become tokens ``U<code point>``."""
    if text.isascii():
        return text
    bare = "".join(c for c in unicodedata.normalize("NFD", text) if not 0x300 <= ord(c) <= 0x36F)
    return "".join(f" U{ord(c)} " if unicodedata.category(c) == "Lo" else c for c in bare)


@F.pandas_udf(T.StringType())
def fold(texts: pd.Series) -> pd.Series:
    return texts.map(fold_text, na_action="ignore")


@cache
def accented() -> tuple[str, str]:
    """All characters that are an ASCII character with marks, and those without their marks."""
    bare = {c: "".join(x for x in unicodedata.normalize("NFD", c) if not 0x300 <= ord(x) <= 0x36F) for c in map(chr, range(0x80, 0x10000)) if not 0xD800 <= ord(c) < 0xE000}
    found = [(c, b) for c, b in bare.items() if len(b) == 1 and b.isascii()]
    return "".join(c for c, _ in found), "".join(b for _, b in found)


def fold_accents(text: Column) -> Column:
    """``fold_text`` up to characters that are no words: in the JVM, but for texts with letters without case."""
    caseless = fold(F.when(text.rlike(r"\p{Lo}"), text))
    return F.coalesce(caseless, F.regexp_replace(F.translate(text, *accented()), "[\u0300-\u036f]", ""))


@F.pandas_udf(T.StringType())
def stem_word_fully(words: pd.Series) -> pd.Series:
    return words.map(lambda w: stem(w, True), na_action="ignore")


def letter_kinds(word: str) -> str:
    """An expression for a word's consonants and vowels as ``c`` and ``v``; y is a vowel after a consonant (up to eight in a row)."""
    out = f"regexp_replace(regexp_replace({word}, '[^aeiouy]', 'c'), '[aeiou]', 'v')"
    for _ in range(4):
        out = f"regexp_replace(regexp_replace({out}, '(^|v)y', '$1c'), 'cy', 'cv')"
    return out


def stem_first_step(word: str) -> Column:
    """The stemmer's first step as an expression; words of one or two letters stay as they are."""
    singular = f"CASE WHEN endswith({word}, 'sses') OR endswith({word}, 'ies') THEN left({word}, length({word}) - 2) WHEN endswith({word}, 's') AND NOT endswith({word}, 'ss') THEN left({word}, length({word}) - 1) ELSE {word} END"
    restored = f"""CASE
        WHEN endswith(t, 'at') OR endswith(t, 'bl') OR endswith(t, 'iz') THEN concat(t, 'e')
        WHEN length(t) > 1 AND right(t, 1) = substr(t, -2, 1) AND endswith({letter_kinds("t")}, 'c') THEN CASE WHEN right(t, 1) IN ('l', 's', 'z') THEN t ELSE left(t, length(t) - 1) END
        WHEN {letter_kinds("t")} RLIKE '^c*v+c$' AND {letter_kinds("t")} RLIKE 'cvc$' AND right(t, 1) NOT IN ('w', 'x', 'y') THEN concat(t, 'e')
        ELSE t END"""
    cut = lambda n: f"transform(array(left(w, length(w) - {n})), t -> {restored})[0]"
    # A part without a, e, i, o, u has a vowel exactly if a y follows its first letter.
    voiced = lambda n: f"left(w, length(w) - {n}) RLIKE '[aeiou]|.y'"
    stemmed = f"""CASE
        WHEN endswith(w, 'eed') THEN CASE WHEN {letter_kinds("left(w, length(w) - 3)")} RLIKE 'vc' THEN left(w, length(w) - 1) ELSE w END
        WHEN endswith(w, 'ed') AND {voiced(2)} THEN {cut(2)}
        WHEN endswith(w, 'ing') AND {voiced(3)} THEN {cut(3)}
        ELSE w END"""
    ends = f"CASE WHEN length({word}) < 3 OR NOT {word} RLIKE '(s|ed|ing)$' THEN {word} ELSE transform(array({singular}), w -> {stemmed})[0] END"
    return F.expr(ends)


def plain_query(text: str) -> list[str]:
    """``plain_terms`` of a query in the driver."""
    return re.findall("[a-z0-9]+", text.lower())


def query_text(text: str) -> str:
    """What ``full_tokens`` does to a text before it is split, to a query in the driver; quotation marks stay."""
    for pattern, by in ((DOTTED_INITIAL, r"\2\3\4"), (PAIR_AT_START, r"\2\3 "), (PAIR_AFTER_SPACE, r"\2\3 ")):
        text = re.sub(pattern, by, text).strip(" ")
    return re.sub('[^a-zA-Z0-9"\n]', " ", fold_text(text)).lower()


def remove_punctuation(text: str | Column, keep: str = "") -> Column:
    return F.regexp_replace(_col(text), f"[^a-zA-Z0-9{keep}\n]", " ")


def split_words(text: str | Column) -> Column:
    return F.filter(F.split(_col(text), r"\s+"), lambda t: t != "")


def strip_markup(html: str | Column) -> Column:
    """The visible text of a page: without comments, invisible elements and tags; common entities resolved."""
    out = F.regexp_replace(F.coalesce(_col(html), F.lit("")), r"(?is)<!--.*?-->|<(script|style|nav|noscript|head)\b.*?</\1>", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"[ \t]+", " "))


def page_title(html: str | Column) -> Column:
    return F.regexp_extract(F.coalesce(_col(html), F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1)


def tokens(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, pos, term`` by the plain analyzer; positions start at 0."""
    return docs.select("doc_id", F.posexplode(plain_terms(text)).alias("pos", "term"))


def full_tokens(docs: DataFrame, text: str = "text", stemmed: bool = True, full: bool = False) -> DataFrame:
    """``doc_id, pos, term`` by the full analyzer; stems are computed once per distinct word."""
    folded = fold_accents(remove_initials_dots(F.coalesce(F.col(text), F.lit(""))))
    out = docs.select("doc_id", F.posexplode(split_words(F.lower(remove_punctuation(folded)))).alias("pos", "term"))
    if not stemmed:
        return out
    if not full:
        return out.select("doc_id", "pos", stem_first_step("term").alias("term"))
    words = out.select("term").distinct().withColumn("stem", stem_word_fully("term"))
    return out.join(words, "term").select("doc_id", "pos", F.col("stem").alias("term"))


def clean_log_query(query: str | Column) -> Column:
    """Runs of other than letters, digits and dots become one space; none at the end."""
    return F.rtrim(F.regexp_replace(_col(query), r"[^\p{Alnum}.]+", " "))


def short_url(url: str | Column) -> Column:
    """More than five parts: the first three, dots, the last two."""
    parts = F.split(_col(url), "/")
    return F.when(F.size(parts) > 5, F.concat_ws("/", F.slice(parts, 1, 3), F.lit("..."), F.slice(parts, -2, 2))).otherwise(_col(url))


def known_names(names: DataFrame, known: DataFrame) -> DataFrame:
    """Names whose MD5 is among those of the known ones."""
    return names.join(known.select(F.md5("name").alias("_md5")).distinct(), F.md5("name") == F.col("_md5"), "left_semi")

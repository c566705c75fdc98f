"""The Porter stemmer (M. F. Porter, 1980), by default its first step only."""

from __future__ import annotations

import re
from functools import lru_cache

#: Suffixes, replacements by step, longest match first.
STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log"}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def shape(word: str) -> str:
    """Consonants and vowels as ``c`` and ``v``; y is a vowel after a consonant."""
    out = ""
    for k, letter in enumerate(word):
        vowel = letter in "aeiou" or letter == "y" and k > 0 and out[-1] == "c"
        out += "v" if vowel else "c"
    return out


def measure(stem: str) -> int:
    return len(re.findall("v+c+", shape(stem)))


def _short_end(stem: str) -> bool:
    return shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def _step1(word: str) -> str:
    if word.endswith("s"):
        if word.endswith(("sses", "ies")):
            word = word[:-2]
        elif not word.endswith("ss"):
            word = word[:-1]
    if word.endswith("eed"):
        return word[:-1] if measure(word[:-3]) > 0 else word
    for suffix in ("ed", "ing"):
        stem = word.removesuffix(suffix)
        if stem != word and "v" in shape(stem):
            if stem.endswith(("at", "bl", "iz")):
                return stem + "e"
            if len(stem) > 1 and stem[-1] == stem[-2] and shape(stem)[-1] == "c":
                return stem if stem[-1] in "lsz" else stem[:-1]
            return stem + "e" if measure(stem) == 1 and _short_end(stem) else stem
    return word


def _later_steps(word: str) -> str:
    if word.endswith("y") and "v" in shape(word[:-1]):
        word = word[:-1] + "i"
    for table in (STEP2, STEP3):
        for suffix in sorted(table, key=len, reverse=True):
            if word.endswith(suffix):
                stem = word[: -len(suffix)]
                word = stem + table[suffix] if measure(stem) > 0 else word
                break
    for suffix in sorted(STEP4, key=len, reverse=True):
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            if measure(stem) > 1 and (suffix != "ion" or stem.endswith(("s", "t"))):
                word = stem
            break
    if word.endswith("e"):
        m = measure(word[:-1])
        if m > 1 or m == 1 and not _short_end(word[:-1]):
            word = word[:-1]
    return word[:-1] if word.endswith("ll") and measure(word) > 1 else word


@lru_cache(maxsize=100_000)
def stem(word: str, full: bool = False) -> str:
    """Words of one or two letters stay as they are; ``full`` adds steps 2 to 5 and y to i."""
    if len(word) < 3:
        return word
    word = _step1(word)
    return _later_steps(word) if full else word

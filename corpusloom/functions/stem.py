"""Tokens as the reference's index makes them: letters and digits without diacritics, stemmed by Porter's algorithm."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Endings of Porter's steps 2 and 3 with what they become, and those of step 4.
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "logi": "log", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e",
    "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")
MOST = 64


def _vowels(w: str) -> list[bool]:
    out: list[bool] = []
    for i, c in enumerate(w):
        out.append(c in "aeiou" or c == "y" and i > 0 and not out[-1])
    return out


def _measure(w: str) -> int:
    """How often a consonant follows a vowel."""
    v = _vowels(w)
    return sum(a and not b for a, b in zip(v, v[1:]))


def _short(w: str) -> bool:
    """Whether w ends consonant, vowel, consonant, the last not w, x or y."""
    v = _vowels(w)
    return len(w) >= 3 and not v[-3] and v[-2] and not v[-1] and w[-1] not in "wxy"


def _ending(w: str, table) -> str | None:
    return max((e for e in table if w.endswith(e)), key=len, default=None)


@lru_cache(maxsize=100_000)
def stem(w: str) -> str:
    if not 3 <= len(w) < MOST or not w.isascii() or not w.isalnum():
        return w
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        base = next((w[: -len(e)] for e in ("ed", "ing") if w.endswith(e)), None)
        if base is not None and any(_vowels(base)):
            w = base
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and not _vowels(w)[-1] and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _short(w):
                w += "e"
    if w.endswith("y") and any(_vowels(w[:-1])):
        w = w[:-1] + "i"
    for table in (STEP2, STEP3):
        e = _ending(w, table)
        if e and _measure(w[: -len(e)]) > 0:
            w = w[: -len(e)] + table[e]
    e = _ending(w, STEP4)
    if e and _measure(w[: -len(e)]) > 1 and (e != "ion" or w[: -len(e)].endswith(("s", "t"))):
        w = w[: -len(e)]
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or m == 1 and not _short(w[:-1]):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def fold(text: str) -> str:
    """Lower case, without combining marks."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))


def split(text: str) -> list[str]:
    out, held = [], []
    for c in fold(text):
        if c.isalnum() or unicodedata.category(c) == "Co":
            held.append(c)
        elif held:
            out.append("".join(held))
            held = []
    return [*out, "".join(held)] if held else out


def tokens(text: Column) -> Column:
    """Stemmed tokens of a text column; null has none."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [stem(w) for w in split(t or "")])

    return F.pandas_udf(run, "array<string>")(text)

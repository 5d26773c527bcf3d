"""Tokens, Hangul 2-grams and English stems."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def bigrams_column(text: Column) -> Column:
    """The overlapping pairs of each run of Hangul syllables, joined by spaces; gaps between syllables don't count."""
    runs = F.regexp_extract_all(F.regexp_replace(text, r"(?<=[가-힣])\s+(?=[가-힣])", ""), F.lit("([가-힣]{2,})"), F.lit(1))
    pairs = F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substr(r, i, F.lit(2))))
    return F.array_join(F.flatten(pairs), " ")


def bigrams(text: str) -> str:
    runs = re.findall("[가-힣]{2,}", re.sub(r"(?<=[가-힣])\s+(?=[가-힣])", "", text))
    return " ".join(r[i : i + 2] for r in runs for i in range(len(r) - 1))


def tokens_column(text: Column) -> Column:
    """Lower-cased runs of letters, numbers and private-use characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}\p{Co}]+)"), F.lit(1))


def fold(token: str) -> str:
    """A token without diacritics."""
    if token.isascii() or re.search("[가-힣]", token):
        return token
    return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", token) if not unicodedata.combining(c)))


_V = r"(?:[aeiou]|(?<=[^aeiou])y)"


def _measure(stem: str) -> int:
    shape = re.sub("v+", "v", re.sub("c+", "c", "".join("v" if c in "aeiou" or c == "y" and i and stem[i - 1] not in "aeiou" else "c" for i, c in enumerate(stem))))
    return shape.count("vc")


def _has_vowel(stem: str) -> bool:
    return any(c in "aeiou" or c == "y" and i for i, c in enumerate(stem))


def _cvc(stem: str) -> bool:
    if len(stem) < 3 or stem[-1] in "aeiouwxy" or stem[-3] in "aeiou":
        return False
    return stem[-2] in "aeiouy"


_STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"
_STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
_STEPS = [sorted((tuple(x.split(":")) for x in table.split()), key=lambda x: -len(x[0])) for table in (_STEP2, _STEP3)]
_STEP4 = sorted("al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split(), key=len, reverse=True)


def stem(word: str) -> str:
    """The Porter stem of a lower-case ASCII word; others, and very short or long ones, stay."""
    if not 3 <= len(word.encode()) <= 64 or not re.fullmatch("[a-z]+", word):
        return word
    w = word
    for end, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(end):
            w = w[: len(w) - len(end)] + new
            break
    again = False
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    elif w.endswith("ed") and _has_vowel(w[:-2]):
        w, again = w[:-2], True
    elif w.endswith("ing") and _has_vowel(w[:-3]):
        w, again = w[:-3], True
    if again:
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif len(w) > 1 and w[-1] == w[-2] and w[-1] not in "aeioulsz":
            w = w[:-1]
        elif _measure(w) == 1 and _cvc(w):
            w += "e"
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in _STEPS:
        for end, new in table:
            if w.endswith(end):
                if _measure(w[: -len(end)]) > 0:
                    w = w[: -len(end)] + new
                break
    for end in _STEP4:
        if w.endswith(end):
            base = w[: -len(end)]
            if _measure(base) > 1 and (end != "ion" or base.endswith(("s", "t"))):
                w = base
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _cvc(w[:-1])):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


@F.pandas_udf(T.StringType())
def term_udf(token: pd.Series) -> pd.Series:
    """Diacritics folded, then stemmed; apply it to distinct tokens."""
    return token.map(lambda t: term(t) if t is not None else None)


TOKEN = regex.compile(r"[\p{L}\p{N}\p{Co}]+")


def tokens(text: str) -> list[str]:
    """The terms of a text: lower-cased tokens, folded and stemmed."""
    return [term(t) for t in TOKEN.findall(text.lower())]


@lru_cache(1 << 17)
def term(token: str) -> str:
    return stem(fold(token))


def query_terms(query: str) -> list[list[str]]:
    """The terms of a query, each as its token stems; control characters go first, so a tab joins."""
    return [t for t in map(tokens, cleaned(query).split()) if t]


def cleaned(query: str) -> str:
    """A query without control characters."""
    return "".join(c for c in query if ord(c) >= 32 and not 127 <= ord(c) < 160)


def snippet(text: str, wanted: list[tuple[list[str], bool]], size: int = 20) -> tuple[str, bool]:
    """At most `size` tokens of a text around its matches, and whether there are any.

    wanted: phrases as (terms, whether the last is a prefix). The window is the first of those with most different
    phrases; what is cut off on either side shows as an ellipsis. Without a match it is the beginning.
    """
    spans = [m.span() for m in TOKEN.finditer(text)]
    terms = [term(text[a:b].lower()) for a, b in spans]
    hits: list[tuple[int, int]] = []
    for p, (phrase, prefix) in enumerate(wanted):
        n = len(phrase)
        for i in range(len(terms) - n + 1):
            last = terms[i + n - 1].startswith(phrase[-1]) if prefix else terms[i + n - 1] == phrase[-1]
            if last and terms[i : i + n - 1] == phrase[:-1]:
                hits.append((i, p))
    hits.sort()
    start = 0
    if hits:
        best = max(hits, key=lambda h: (len({p for i, p in hits if h[0] <= i < h[0] + size}), -h[0]))
        start = max(0, min(best[0] - 2, len(spans) - size))
        start = min(start, best[0])
    stop = min(len(spans), start + size)
    if not spans:
        return text[:0], False
    head = "" if start == 0 else "…"
    tail = "" if stop == len(spans) else "…"
    a = 0 if start == 0 else spans[start][0]
    b = len(text) if stop == len(spans) else spans[stop - 1][1]
    return head + text[a:b] + tail, bool(hits)

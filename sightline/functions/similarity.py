"""String similarity scores from 0 to 100, and Arrow functions over them.

`ratio` is the insertion-deletion similarity 2 * LCS / (len a + len b).
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel over a."""
    if not a or not b:
        return 0
    place: dict[str, int] = {}
    for i, c in enumerate(a):
        place[c] = place.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & place.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def ratio(a: str, b: str) -> float:
    """100 for two empty texts."""
    n = len(a) + len(b)
    return 200.0 * lcs(a, b) / n if n else 100.0


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter text with a stretch of the longer that is no longer than it."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    n, best = len(a), 0.0
    for k in range(1 - n, len(b)):
        piece = b[max(0, k) : k + n]
        best = max(best, ratio(a, piece))
        if best == 100.0:
            break
    return best


def _words(s: str) -> list[str]:
    return s.split()


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(_words(a))), " ".join(sorted(_words(b))))


def _parts(a: str, b: str) -> tuple[str, str, str]:
    x, y = set(_words(a)), set(_words(b))
    return " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))


def token_set_ratio(a: str, b: str) -> float:
    if not _words(a) or not _words(b):
        return 0.0
    both, only_a, only_b = _parts(a, b)
    if both and (not only_a or not only_b):
        return 100.0
    one, two = (f"{both} {x}".strip() for x in (only_a, only_b))
    best = ratio(one, two)
    if both:
        best = max(best, ratio(both, one), ratio(both, two))
    return best


def partial_token_ratio(a: str, b: str) -> float:
    """The better of the partial ratios of sorted words and of the words that differ; 100 if any word is shared."""
    both, only_a, only_b = _parts(a, b)
    if both:
        return 100.0
    return max(partial_ratio(" ".join(sorted(_words(a))), " ".join(sorted(_words(b)))), partial_ratio(only_a, only_b))


@lru_cache(1 << 16)
def wratio(a: str, b: str) -> float:
    """Weighted ratio: whole and word-wise scores for texts of like length, partial ones otherwise."""
    if not a or not b:
        return 0.0
    longer, shorter = max(len(a), len(b)), min(len(a), len(b))
    whole, words = ratio(a, b), 0.95
    if longer < 1.5 * shorter:
        return max(whole, words * max(token_sort_ratio(a, b), token_set_ratio(a, b)))
    scale = 0.9 if longer <= 8 * shorter else 0.6
    return max(whole, scale * partial_ratio(a, b), words * scale * partial_token_ratio(a, b))


def jaro_winkler(a: str, b: str) -> float:
    """Jaro-Winkler similarity from 0 to 1: prefix weight 0.1 up to four characters, only above a Jaro of 0.7."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken, mine = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                mine.append(c)
                break
    m = len(mine)
    if not m:
        return 0.0
    theirs = [c for c, t in zip(b, taken, strict=True) if t]
    moved = sum(x != y for x, y in zip(mine, theirs, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    if jaro <= 0.7:
        return jaro
    prefix = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return jaro + 0.1 * prefix * (1 - jaro)


def smart_form(text: str) -> str:
    """Trimmed, in lower case, digits and letters apart."""
    return re.sub(r"(?<=[0-9])(?=[a-z])|(?<=[a-z])(?=[0-9])", " ", text.lower().strip())


def smart_score(a: str, b: str) -> float:
    """Both of several words: wratio; both short (6 at most): Jaro-Winkler; else the partial ratio."""
    a, b = smart_form(a), smart_form(b)
    if not a or not b:
        return 0.0
    if len(_words(a)) > 1 and len(_words(b)) > 1:
        return wratio(a, b)
    if max(len(a), len(b)) <= 6:
        return 100 * jaro_winkler(a, b)
    return partial_ratio(a, b)


SCORERS = {"ratio": ratio, "partial_ratio": partial_ratio, "token_sort_ratio": token_sort_ratio, "token_set_ratio": token_set_ratio, "wratio": wratio, "jaro_winkler": jaro_winkler, "smart_score": smart_score}


def score(name: str, a, b):
    """A score of two string columns; null if either is null."""
    f = SCORERS[name]

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else f(p, q) for p, q in zip(x, y, strict=True)], dtype="float64")

    return run(a, b)

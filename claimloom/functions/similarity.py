"""Similarity of short strings, 0 to 100, from longest common subsequences."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def common_length(a: str, b: str) -> int:
    """The length of the longest common subsequence, by bit-parallel rows (one big integer a row)."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & masks.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """200 x common length / summed length; 100 for two empty strings."""
    return 200 * common_length(a, b) / (len(a) + len(b)) if a or b else 100.0


def sorted_ratio(a: str, b: str) -> float:
    """``ratio`` of the words in alphabetical order."""
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def _word_sets(a: str, b: str) -> tuple[str, str, str]:
    """The words that two strings share, and the rests of either, each in alphabetical order."""
    x, y = set(a.split()), set(b.split())
    return tuple(" ".join(sorted(s)) for s in (x & y, x - y, y - x))


def set_ratio(a: str, b: str) -> float:
    """The best ``ratio`` among the shared words and the shared words with either rest; 0 where a string has no words."""
    if not a.split() or not b.split():
        return 0.0
    both, one, two = _word_sets(a, b)
    if both and (not one or not two):
        return 100.0
    left, right = f"{both} {one}".strip(), f"{both} {two}".strip()
    return max(ratio(left, right), ratio(both, left) if both else 0, ratio(both, right) if both else 0)


def partial_ratio(a: str, b: str) -> float:
    """The best ``ratio`` of the shorter string with a stretch of the longer one that is as long, or shorter at either end; of two equally long ones, either may be cut."""
    if not a or not b:
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    n = len(a)
    stretches = {b[max(0, i) : i + n] for i in range(1 - n, len(b))}
    best = max(ratio(a, s) for s in stretches)
    if n == len(b) and best < 100:
        best = max(best, *(ratio(a[max(0, i) : i + n], b) for i in range(1 - n, n)))
    return best


def partial_words_ratio(a: str, b: str) -> float:
    """100 where a word is shared, else the best ``partial_ratio`` of the words in alphabetical order."""
    if set(a.split()) & set(b.split()):
        return 100.0
    return max(partial_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split()))), partial_ratio(*_word_sets(a, b)[1:]))


@lru_cache(maxsize=1 << 16)
def _letters(text: str) -> Counter:
    return Counter(text)


def shared_letters(a: str, b: str) -> int:
    """How many letters two strings share, with repeats: no less than their longest common subsequence, in whatever order their words are."""
    if len(a) > len(b):
        a, b = b, a
    other = _letters(b)
    return sum(min(n, other[c]) for c, n in _letters(a).items())


def composite_ratio(a: str, b: str, least: float = 0.0) -> float:
    """The weighted composite score: the best of ratio and 0.95 x the word-order-free ratios; from a length ratio of 1.5 on partial ratios stand in for the latter, x 0.9, or x 0.6 beyond a length ratio of 8.

    A score below ``least`` may be given as 0, which is found out early: strings that share and repeat no word score no more than their shared letters allow.
    """
    if not a or not b:
        return 0.0
    short, long = sorted((len(a), len(b)))
    lengths = long / short
    scale = 1.0 if lengths < 1.5 else 0.9 if lengths <= 8 else 0.6
    if least:
        if 100 * scale < least:
            return 0.0
        x, y = a.split(), b.split()
        if not set(x) & set(y) and len(set(x)) == len(x) and len(set(y)) == len(y):
            common = shared_letters(a, b)
            if scale * 200 * common < least * (short + (common if scale < 1 else long)):
                return 0.0
    if lengths < 1.5:
        return max(ratio(a, b), 0.95 * sorted_ratio(a, b), 0.95 * set_ratio(a, b))
    return max(ratio(a, b), scale * partial_ratio(a, b), 0.95 * scale * partial_words_ratio(a, b))


def _scored(score):  # noqa: ANN001, ANN202
    @F.pandas_udf(T.DoubleType())
    def scores(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in batches:
            yield pd.Series([None if a is None or b is None else score(a, b) for a, b in zip(left, right)], dtype="float64")

    return scores


ratio_score, sorted_score, composite_score = _scored(ratio), _scored(sorted_ratio), _scored(composite_ratio)


def composite_score_from(least: float):  # noqa: ANN201
    """``composite_score`` that may give 0 below ``least``."""
    return _scored(lambda a, b: composite_ratio(a, b, least))


def sorted_words(text: Column) -> Column:
    """The words of a text in alphabetical order."""
    return F.array_join(F.array_sort(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")), " ")


def may_reach(a: Column, b: Column, score: float) -> Column:
    """A cheap necessary condition, in the JVM, for ``ratio(a, b) >= score``: lengths and edit distance.

    A ratio r means (1 - r/100) x summed length insertions and deletions, and there are at most as many edits.
    """
    total = F.length(a) + F.length(b)
    common = F.least(F.length(a), F.length(b))
    most = F.floor(total * (100 - score) / 100 + 1e-9).cast("int")
    near = F.call_function("levenshtein", a, b, most) >= 0  # banded, gives up beyond the bound
    return (200 * common >= score * total) & near

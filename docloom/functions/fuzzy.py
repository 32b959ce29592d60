"""Fuzzy ratios of texts to a literal query that no built-in function has, in Arrow batches: partial and weighted."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions import text as T


def _masks(word: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(word):
        out[c] = out.get(c, 0) | 1 << i
    return out


def _common(masks: dict[str, int], m: int, text: str) -> int:
    """Length of the longest common subsequence, with a bit for each character of the masked word."""
    full = state = (1 << m) - 1
    for c in text:
        hit = state & masks.get(c, 0)
        state = ((state + hit) | (state - hit)) & full
    return m - state.bit_count()


def ratio(a: str, b: str) -> float:
    """Indel ratio, 0 to 100; two empty texts are equal."""
    return 200.0 * _common(_masks(a), len(a), b) / (len(a) + len(b)) if a or b else 100.0


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter text to a window of its length in the longer one, windows cut at both ends included."""
    if not a or not b:
        return 0.0 if a or b else 100.0
    if len(a) > len(b):
        a, b = b, a
    best = 0.0
    for short, long in ((a, b), (b, a))[: 1 + (len(a) == len(b))]:
        masks, m = _masks(short), len(short)
        for at in range(1 - m, len(long)):
            part = long[max(0, at) : at + m]
            if 200.0 * len(part) / (m + len(part)) > best:  # no window can share more than its length
                best = max(best, 200.0 * _common(masks, m, part) / (m + len(part)))
                if best == 100.0:
                    return best
    return best


def _token_ratios(a: str, b: str, whole) -> float:
    """The better of sorted tokens and token sets, compared by ``whole`` (ratio or partial_ratio)."""
    one, two = set(a.split()), set(b.split())
    best = whole(" ".join(sorted(a.split())), " ".join(sorted(b.split())))
    if not one or not two:
        return best
    both, left, right = (" ".join(sorted(x)) for x in (one & two, one - two, two - one))
    if whole is partial_ratio:
        return max(best, 100.0 if both else whole(left, right))
    if both and not (left and right):
        return 100.0
    longer = [" ".join(filter(None, (both, x))) for x in (left, right)]
    # the shared tokens lead both texts, so they are common as a whole
    apart = len(left) + len(right) - 2 * _common(_masks(left), len(left), right)
    found = [100.0 * (1 - apart / (len(longer[0]) + len(longer[1])))]
    found += [200.0 * len(both) / (len(both) + len(x)) for x in longer if both]
    return max(best, *found)


def weighted_ratio(a: str, b: str) -> float:
    """The best of whole, token and (for lengths 1.5 times apart) partial ratios, each by its weight; 0 for an empty text."""
    if not a or not b:
        return 0.0
    apart = max(len(a), len(b)) / min(len(a), len(b))
    if apart < 1.5:
        return max(ratio(a, b), 0.95 * _token_ratios(a, b, ratio))
    scale = 0.9 if apart <= 8 else 0.6
    return max(ratio(a, b), scale * partial_ratio(a, b), scale * 0.95 * _token_ratios(a, b, partial_ratio))


def _column(f, query: str, text: Column) -> Column:
    """f(query, text) in Arrow batches; equal texts of a batch are scored once."""

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map({t: f(query, t) for t in texts.dropna().unique()}).astype("float64")

    return run(text)


def indel(text: Column, query: str) -> Column:
    """The Indel ratio to a query of any length: in built-in functions as long as a long holds its bits, in Arrow batches beyond."""
    return T.indel_ratio(text, query) if len(query) <= T.INDEL_MOST else _column(ratio, query, text)


def partial(text: Column, query: str) -> Column:
    """partial_ratio to a query; null for a null text."""
    return _column(partial_ratio, query, text)


def weighted(text: Column, query: str) -> Column:
    """weighted_ratio to a query, case kept; null for a null text."""
    return _column(weighted_ratio, query, text)

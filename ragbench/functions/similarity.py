"""String similarity as Arrow UDFs, for pairs that a join has already narrowed down."""

from __future__ import annotations

import math
from collections.abc import Hashable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lcs_length(a: Sequence[Hashable], b: Sequence[Hashable]) -> int:
    """Longest common subsequence: one bit for each element of ``a``, one machine-word step for each of ``b``."""
    masks: dict[Hashable, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        hit = row & masks.get(x, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def indel(a: Sequence[Hashable], b: Sequence[Hashable]) -> float:
    """200 * LCS / (length of both); 100 for two empty strings."""
    return 200 * lcs_length(a, b) / (len(a) + len(b)) if a or b else 100.0


def partial(a: str, b: str, cutoff: float = 0.0) -> float:
    """Best Indel ratio of the shorter string with a stretch of the longer: all windows of its length, and those cut at either end.

    Moving a window by one place raises the common subsequence by one at most, so places that can't beat the best
    ratio so far (or ``cutoff``; below it the answer is 0) are passed over.
    """
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    if a in b:
        return 100.0
    m, best, start = len(a), cutoff, 0
    found = 0.0
    while start <= len(b) - m:
        ratio = indel(a, b[start : start + m])
        if ratio >= best:
            best = found = max(best, ratio)
        start += max(1, math.ceil((best - ratio) * m / 100))
    for size in range(m - 1, 0, -1):
        if 200 * size / (m + size) < best:
            break
        for window in (b[:size], b[-size:]):
            ratio = indel(a, window)
            if ratio >= best:
                best = found = max(best, ratio)
    return found


def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else indel(x, y) for x, y in zip(a, b)], dtype="float64")


def _token_lcs(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else lcs_length(list(x), list(y)) for x, y in zip(a, b)], dtype="Int64")


def indel_ratio(a: Column, b: Column) -> Column:
    return F.pandas_udf(_ratio, T.DoubleType())(a, b)


def partial_ratio(a: Column, b: Column, cutoff: float = 0.0) -> Column:
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else partial(p, q, cutoff) for p, q in zip(x, y)], dtype="float64")

    return F.pandas_udf(run, T.DoubleType())(a, b)


def token_lcs(a: Column, b: Column) -> Column:
    """LCS length of two token arrays."""
    return F.pandas_udf(_token_lcs, T.LongType())(a, b)

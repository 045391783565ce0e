"""Similarity joins of strings by the Indel ratio, exact and without comparing all pairs.

Two strings of m <= n characters have a ratio of ``least`` or more iff their distance (insertions and deletions) is at most
tau = floor((1 - least / 100)(m + n)), less one if m + n - tau is odd, as the distance has the parity of m + n. The shorter one is cut
into tau + 2 segments. An operation lies in at most one of them, so at least two come through whole. Of the first two that do, numbers i < j,
each of the i segments before i and of the j - i - 1 between them holds an operation. If they are found in the longer string shifted by a and b,
then e(i, a) + e(j - i - 1, b - a) + |n - m - b| <= tau, where e(c, x) is the least number of operations, at least c, that shifts by x: the larger of c and
|x|, plus one if its parity isn't that of x. So every similar pair has a signature (m, n, i, j and both segments) in common with the shorter string's
own segments and the longer string's stretches at those shifts, and few others do: two segments are some third of a string at 85.

Two whole segments are little where few characters and words are used, so strings are cut more coarsely for a second kind of signature: into pieces that may
hold t operations each, t being 2 or less and the t + 1 summing up to tau + 1, so that one piece at least keeps to its t. Such a piece without D of its characters equals
the longer string's stretch at its place without I, for some D + I <= t (``ways``). The first and the last piece have but one place; others are looked for where both of
these hold more operations than they may, which leaves few shifts.

Signatures are many, so they aren't shuffled: strings are dealt to cells, one for each two lengths (and blocks of at most ``BLOCK`` strings), and a
cell's task makes the signatures of the second kind for one piece at a time, passes over those met whose characters alone differ too much, and compares the rest.

Longer strings than ``SEGMENTED`` have too many stretches; they are joined by their rarest character pairs, of which an operation touches two.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from copy import copy
from functools import lru_cache
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragbench.functions.similarity import indel_ratio
from ragbench.sources.shared import written

#: The greatest length joined by segments.
SEGMENTED = 40
#: The most strings on a side of a cell (2^18 at most), rows that a partition of cells should have, pairs and signatures that a task holds at once, pairs that it looks at in one step.
BLOCK, DEALT, HELD, SIGNED, STEP = 250_000, 50_000, 1 << 20, 1 << 22, 1 << 16
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: The last bits of a signature that are its string's row.
_ROWS = np.uint64(18)
_ROW = np.uint64((1 << 18) - 1)


def distance_bound(m: int, n: int, least: float) -> int:
    """The greatest Indel distance of strings of m and n characters with the ratio ``least``; below 0 if their lengths alone are too far apart."""
    tau = int((100 - least) * (m + n) / 100 + 1e-9)
    tau -= (m + n - tau) % 2
    return tau if tau >= abs(n - m) else -1


def _least_operations(count: int, shift: int) -> int:
    at_least = max(count, abs(shift))
    return at_least + (at_least - shift) % 2


def segments(m: int, number: int) -> list[tuple[int, int]]:
    """(start, length) of segments that cover m characters; with more segments than characters some are empty."""
    cuts = [m * k // number for k in range(number + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


@lru_cache(maxsize=None)
def places(m: int, n: int, least: float, longer: bool) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (i, j, start, length, start, length) of strings of m <= n characters: the shorter one's segments, or where they may be in the longer one."""
    rows, gap = [], n - m
    tau = distance_bound(m, n, least)
    parts = segments(m, tau + 2)
    for j in range(1, tau + 2):
        for i in range(j):
            (p, k), (q, l) = parts[i], parts[j]
            if not longer:
                rows.append((i, j, p, k, q, l))
                continue
            for a in range(-tau, tau + 1):
                first = _least_operations(i, a)
                for b in range(-tau, tau + 1):
                    if first + _least_operations(j - i - 1, b - a) + abs(gap - b) <= tau and p + a >= 0 and q + b >= p + a + k and q + b + l <= n:
                        rows.append((i, j, p + a, k, q + b, l))
    return rows


@lru_cache(maxsize=None)
def stretches(n: int, least: float, longer: bool) -> np.ndarray:
    """Rows (m, n, i, j, start, length, start, length): where a string of n characters holds its signatures, as the longer or the shorter one."""
    rows = []
    for other in range(1, SEGMENTED + 1):
        m, upto = (other, n) if longer else (n, other)
        if m <= upto and distance_bound(m, upto, least) >= 0:
            rows += [(m, upto, *row) for row in places(m, upto, least, longer)]
    return np.array(sorted(set(rows)), dtype=np.int64).reshape(-1, 8)


def signatures(text: str, least: float, longer: bool) -> np.ndarray:
    """64-bit hashes of a string's signatures. Equal ones always meet; different ones that meet cost a comparison and nothing else."""
    at = stretches(len(text), least, longer)
    codes = np.array([ord(c) + 1 for c in text], dtype=np.uint64)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.concatenate((np.ones(1, dtype=np.uint64), np.full(SEGMENTED, _BASE, dtype=np.uint64))))
        prefix = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(codes * powers[: len(text)])))
        out = np.zeros(len(at), dtype=np.uint64)
        for column in range(4):
            out = (out ^ at[:, column].astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        for start, length in ((at[:, 4], at[:, 5]), (at[:, 6], at[:, 7])):
            # A sum from its start on, brought to one power so that the place doesn't matter.
            piece = (prefix[start + length] - prefix[start]) * powers[SEGMENTED - start]
            out = (out ^ (piece ^ (piece >> np.uint64(29)))) * np.uint64(0x94D049BB133111EB)
            out ^= out >> np.uint64(31)
    return np.unique(out).view(np.int64)


def _signed(text: Column, least: float, longer: bool) -> Column:
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([signatures(t, least, longer) for t in texts])

    return F.pandas_udf(run, T.ArrayType(T.LongType()))(text)


def _rare_pairs(rows: DataFrame, frequency: DataFrame, least: float) -> DataFrame:
    """(id, gram, size): of each string's distinct character pairs the rarest, so many that one of a similar string's is left among them."""
    grams = _grams(rows).join(frequency.hint("shuffle_merge"), "gram", "left")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.coalesce("df", F.lit(0)), "gram"))
    # The two strings together hold (1 - least / 100)(m + n) operations, and n <= m (200 - least) / least.
    keep = F.floor((F.lit(100.0) - least) / 100 * (1 + (200 - least) / least) * F.col("size") * 2) + 1
    return grams.withColumn("n", rank).where(F.col("n") <= keep).select("id", "gram", "size")


def _grams(rows: DataFrame) -> DataFrame:
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length("text") - 1, F.lit(1))), lambda i: F.col("text").substr(i, F.lit(2)))
    return rows.select("id", F.length("text").alias("size"), F.explode(F.array_distinct(pairs)).alias("gram"))


def candidates(left: DataFrame, right: DataFrame | None, least: float) -> DataFrame:
    """(left_id, right_id) of the pairs of (id, text) that share a signature: all similar ones and few others.

    Without ``right``, pairs of the left's rows with left_id < right_id.
    """
    tables = [left] if right is None else [left, right]
    short = [t.where(F.length("text") <= SEGMENTED) for t in tables]
    own, wide = ([t.select("id", F.explode(_signed(F.col("text"), least, longer)).alias("signature")) for t in short] for longer in (False, True))
    found = _met(own[0], wide[-1], "signature") if right is None else _met(own[0], wide[1], "signature").unionByName(_met(wide[0], own[1], "signature"))
    long = long_candidates(left, right, least)
    return _once(found if long is None else found.unionByName(long), right is None)


def _met(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
    return a.select(F.col("id").alias("left_id"), on).hint("shuffle_merge").join(b.select(F.col("id").alias("right_id"), on).hint("shuffle_merge"), on).select("left_id", "right_id")


def _once(pairs: DataFrame, alike: bool) -> DataFrame:
    if alike:
        pairs = pairs.select(F.least("left_id", "right_id").alias("left_id"), F.greatest("left_id", "right_id").alias("right_id")).where("left_id < right_id")
    return pairs.distinct()


def pieces(m: int, tau: int) -> list[tuple[int, int, int]]:
    """(start, length, operations it may hold) of pieces that cover m characters; tau operations can't be too many for all of them."""
    inner = tau - 5
    if inner > 0:
        may = [2] + [1] * (inner // 2) + [0] * (inner % 2) + [2]
    else:
        may = {0: [0], 1: [1], 2: [2], 3: [1, 1], 4: [2, 1], 5: [2, 2]}[tau]
    # As measured on words: pieces that may hold less, or have but one place, can do with less.
    weights = [5 + t + (0 < k < len(may) - 1) for k, t in enumerate(may)]
    cuts = [round(m * sum(weights[:k]) / sum(weights)) for k in range(len(may) + 1)]
    return [(a, b - a, t) for a, b, t in zip(cuts, cuts[1:], may)]


@lru_cache(maxsize=None)
def ways(m: int, n: int, tau: int) -> dict[tuple[int, int, int], list[tuple[int, int, int]]]:
    """By stretch of the shorter string (start, length, characters left out): such stretches of the longer one that it may equal."""
    out: dict[tuple[int, int, int], list] = {}
    parts, gap = pieces(m, tau), n - m
    last = len(parts) - 1
    # The first piece is looked for, then the last, then the others in order: those looked for before held too much.
    over = [t + 1 for _, _, t in parts]
    for k, (start, size, may) in enumerate(parts):
        for longer in range(-min(may, size), may + 1):
            if k == 0:
                shifts, before, after = [0], 0, 0
            elif k == last:
                shifts, before, after = [gap - longer], over[0], 0
            else:
                shifts, before, after = range(-tau, tau + 1), sum(over[:k]), over[last]
            for shift in shifts:
                beyond = gap - shift - longer
                if (k == last and beyond) or start + shift < 0 or start + shift + size + longer > n:
                    continue
                spare = tau - _least_operations(before, shift) - _least_operations(after, beyond)
                # Of equal shifts that which leaves most out finds what the others do.
                out_of = next((d for d in range(min(size, may), -1, -1) if d + longer >= 0 and 2 * d + longer <= min(may, spare)), None)
                if out_of is not None:
                    out.setdefault((start, size, out_of), []).append((start + shift, size + longer, out_of + longer))
    return out


class _Side:
    """The strings of one length on a side of a cell: characters, running sums for the hashes of stretches, characters and their pairs as bits."""

    def __init__(self, texts: list[str], size: int):
        self.codes = np.array(texts, dtype=f"U{size}").view(np.uint32).reshape(-1, size)
        self.powers = np.cumprod(np.concatenate((np.ones(1, dtype=np.uint64), np.full(SEGMENTED + 2, _BASE, dtype=np.uint64))))
        self.bag = np.zeros(len(texts), dtype=np.uint64)
        self.prefix = np.zeros((size + 1, len(texts)), dtype=np.uint64)
        np.cumsum((self.codes.T.astype(np.uint64) + np.uint64(1)) * self.powers[:size, None], axis=0, out=self.prefix[1:])
        # Character pairs set a bit each; an operation takes away two and brings one, or the reverse.
        self.pairs = np.zeros((2, len(texts)), dtype=np.uint64)
        for one, two in zip(self.codes.T, self.codes.T[1:]):
            bit = ((one.astype(np.uint64) * np.uint64(0x9E3779B1) + two) * _BASE) >> np.uint64(57)
            for k in range(2):
                self.pairs[k] |= np.where(bit & np.uint64(1) == k, np.uint64(1) << (bit >> np.uint64(1)), np.uint64(0))

    def sample(self, begin: float) -> _Side:
        """Some 2,000 of its strings, for sums over stretches alone; from another share of the way on, other ones."""
        step, out = max(1, len(self.bag) // 2048), copy(self)
        some = slice(int(begin * step), None, step)
        out.bag, out.prefix = self.bag[some], self.prefix[:, some]
        return out

    def signed(self, start: int, size: int, out_of: int, part: int, parts: int) -> np.ndarray:
        """In order: hashes of a stretch without ``out_of`` (two at most) of its characters, in every way, with the string's row as the last bits; one part of them."""
        # A sum from its start on, each character at its place among those that stay.
        at = [self.prefix[start : start + size + 1] * self.powers[SEGMENTED + 2 - start - gone] for gone in range(out_of + 1)]
        whole = at[out_of][size] - at[0][0]
        if out_of == 0:
            sums = iter([whole])
        elif out_of == 1:
            sums = (whole + at[0][i] - at[1][i + 1] for i in range(size))
        else:
            tails = [whole + at[1][j] - at[2][j + 1] for j in range(size)]
            sums = (at[0][i] - at[1][i + 1] + tails[j] for i in range(size) for j in range(i + 1, size))
        row, found = np.arange(len(self.bag), dtype=np.uint64), []
        for z in sums:
            z = (z ^ (z >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            z = (z ^ (z >> np.uint64(32))) & ~_ROW | row
            found.append(z if parts == 1 else z[(z >> np.uint64(40)) % np.uint64(parts) == part])
        out = np.concatenate(found)
        out.sort()
        return out


def _fit_bags(a: _Side, b: _Side) -> None:
    """Sets 64 bits for each string: whether it has this often a character, of those questions that tell the two sides' strings apart best.

    An operation changes one bit at most. Beyond the 31 most frequent characters all others count as one.
    """
    kinds, counts = np.unique(np.concatenate((a.codes.ravel(), b.codes.ravel())), return_counts=True)
    often = np.sort(kinds[np.argsort(-counts, kind="stable")[:31]])
    tables = []
    for side in (a, b):
        table, rows = np.zeros((len(side.codes), len(often) + 1), dtype=np.uint8), np.arange(len(side.codes))
        for column in side.codes.T:
            at = np.minimum(np.searchsorted(often, column), len(often) - 1)
            table[rows, np.where(often[at] == column, at, len(often))] += 1
        tables.append(table)
    asked = []
    for kind in range(len(often) + 1):
        for least in range(1, 9):
            p, q = ((t[:, kind] >= least).mean() for t in tables)
            asked.append((p * (1 - q) + q * (1 - p), kind, least))
    for bit, (_, kind, least) in enumerate(sorted(asked, reverse=True)[:64]):
        for side, table in zip((a, b), tables):
            side.bag |= (table[:, kind] >= least).astype(np.uint64) << np.uint64(bit)


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, where each begins, how many) of ordered values."""
    starts = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    return values[starts], starts, np.diff(np.append(starts, len(values)))


def _ranges(one: np.ndarray, two: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Both sides' ordered signatures by ranges that have some ``STEP`` times eight of the longer side's; those that either lacks don't matter."""
    more = one if len(one) > len(two) else two
    cuts = more[8 * STEP :: 8 * STEP] & ~_ROW
    for x, y in zip(np.split(one, np.searchsorted(one, cuts)), np.split(two, np.searchsorted(two, cuts))):
        if len(x) and len(y):
            yield x, y


def _met_rows(a: _Side, b: _Side, one: np.ndarray, two: np.ndarray, tau: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of strings that share one of the ordered signatures and whose characters may do, by pieces of some ``STEP`` pairs."""
    values, starts, counts = _runs(one >> _ROWS)
    wanted, first, times = _runs(two >> _ROWS)
    at = np.minimum(np.searchsorted(values, wanted), len(values) - 1)
    hit = np.flatnonzero(values[at] == wanted)
    at, times = at[hit], times[hit]
    # The rows of the longer strings that meet some, one after the other.
    y = (two[np.repeat(first[hit] - np.cumsum(times) + times, times) + np.arange(times.sum())] & _ROW).astype(np.int64)
    begin, number = np.repeat(starts[at], times), np.repeat(counts[at], times)
    ends, bags, others = np.cumsum(number), a.bag[(one & _ROW).astype(np.int64)], b.bag[y]
    low = 0
    while low < len(y):
        done = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, done + STEP, "right")))
        n = number[low:high]
        place = np.repeat(begin[low:high] - ends[low:high] + n + done, n) + np.arange(ends[high - 1] - done)
        near = np.flatnonzero(np.bitwise_count(bags[place] ^ np.repeat(others[low:high], n)) <= tau)
        which = low + np.searchsorted(ends[low:high] - done, near, "right")
        yield (one[place[near]] & _ROW).astype(np.int64), y[which]
        low = high


def _signed_pairs(a: _Side, b: _Side, m: int, n: int, tau: int) -> Iterator[tuple[np.ndarray, np.ndarray]] | None:
    """Rows of strings with a signature in common and characters that may do; None if so many share one that looking at all characters is less work."""
    found, sizes = ways(m, n, tau), (len(a.bag), len(b.bag))
    made = [sizes[0] * comb(own[1], own[2]) for own in found], [sizes[1] * comb(other[1], other[2]) for others in found.values() for other in others]
    # As measured: some 60 ns a signature, 15 ns a pair met, 3 ns a pair whose characters are looked at; and what any signature's making takes.
    work = 3 * sizes[0] * sizes[1] - 60 * (sum(made[0]) + sum(made[1])) - 100_000 * sum(map(len, made))
    if work <= 0:
        return None
    met = 0
    some = a.sample(0.0), b.sample(0.5)
    for own, others in found.items():
        values, _, counts = _runs(some[0].signed(*own, 0, 1) >> _ROWS)
        for other in others:
            wanted = some[1].signed(*other, 0, 1) >> _ROWS
            at = np.minimum(np.searchsorted(values, wanted), len(values) - 1)
            met += int(counts[at[values[at] == wanted]].sum())
    if 15 * met * (sizes[0] / len(some[0].bag)) * (sizes[1] / len(some[1].bag)) > work:
        return None

    def run() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for own, others in found.items():
            parts = -(-max(sizes[0] * comb(own[1], own[2]), *(sizes[1] * comb(x[1], x[2]) for x in others)) // SIGNED)
            for part in range(parts):
                one = a.signed(*own, part, parts)
                for other in others:
                    two = b.signed(*other, part, parts)
                    for x, y in _ranges(one, two):
                        yield from _met_rows(a, b, x, y, tau)

    return run()


def _all_pairs(a: _Side, b: _Side, tau: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of all strings whose characters may do."""
    across = 4096
    for low in range(0, len(b.bag), across):
        part = b.bag[low : low + across]
        for x in range(0, len(a.bag), 16):
            one, two = np.divmod(np.flatnonzero(np.bitwise_count(a.bag[x : x + 16, None] ^ part) <= tau), len(part))
            yield x + one, low + two


def _symbols(a: _Side, b: _Side) -> tuple[np.ndarray, np.ndarray, int]:
    """Both sides' characters as numbers of those that the first has (their number for others), and this number."""
    known = np.unique(a.codes)
    at = np.minimum(np.searchsorted(known, b.codes), len(known) - 1)
    return np.searchsorted(known, a.codes).astype(np.int32), np.where(known[at] == b.codes, at, len(known)).astype(np.int32), len(known)


def _common(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, kinds: int) -> np.ndarray:
    """``lcs_length`` of rows ``x`` of ``a`` (64 symbols at most) and rows ``y`` of ``b``: where a row holds a symbol is worked out once for all its pairs."""
    rows, at = np.unique(x, return_inverse=True)
    masks, each = np.zeros((kinds + 1, len(rows)), dtype=np.uint64), np.arange(len(rows))
    for k, column in enumerate(a[rows].T):
        masks[column, each] |= np.uint64(1 << k)
    full = np.uint64((1 << a.shape[1]) - 1)
    row = np.full(len(x), full)
    for column in b[y].T:
        hit = row & masks[column, at]
        row = (row + hit | row - hit) & full
    return a.shape[1] - np.bitwise_count(row).astype(np.int64)


def similar_in_cell(shorter: list[str], longer: list[str] | None, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of the shorter, row of the longer, ratio) of all similar pairs of strings of one length and those of another, or of the same.

    Without ``longer``, pairs of the shorter ones, the first row before the second.
    """
    alike, longer = longer is None, shorter if longer is None else longer
    m, n = len(shorter[0]), len(longer[0])
    tau = distance_bound(m, n, least)
    a = _Side(shorter, m)
    b = a if alike else _Side(longer, n)
    _fit_bags(a, b)
    one, two, kinds = _symbols(a, b)
    step = max(256, min(1 << 16, (1 << 23) // (kinds + 1)))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    held: list[np.ndarray] = []
    size = 0

    def compare() -> None:
        codes = np.sort(np.concatenate(held))
        codes = codes[np.concatenate(([True], codes[1:] != codes[:-1]))] if len(codes) else codes
        held.clear()
        for k in range(0, len(codes), step):
            x, y = np.divmod(codes[k : k + step], len(longer))
            ratio = 200 * _common(one, two, x, y, kinds) / (m + n)
            close = ratio >= least
            found.append((codes[k : k + step][close], ratio[close]))

    for x, y in _signed_pairs(a, b, m, n, tau) or _all_pairs(a, b, tau):
        if alike:
            x, y = x[x < y], y[x < y]
        near = np.bitwise_count(a.pairs[0][x] ^ b.pairs[0][y]) + np.bitwise_count(a.pairs[1][x] ^ b.pairs[1][y]) <= 3 * tau
        x, y = x[near], y[near]
        held.append(x * len(longer) + y)
        size += len(x)
        if size > HELD:
            compare()
            size = 0
    if held:
        compare()
    codes, first = np.unique(np.concatenate([c for c, _ in found] or [np.zeros(0, dtype=np.int64)]), return_index=True)
    return *np.divmod(codes, len(longer)), np.concatenate([r for _, r in found] or [np.zeros(0)])[first]


def _cell_of(least: float) -> Callable:
    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"left_id": left["id"][:0], "right_id": right["other_id"][:0], "ratio": np.zeros(0)})
        if not len(left) or not len(right):
            return none
        one, two = left["id"].to_numpy(), right["other_id"].to_numpy()
        a, b = left["text"].tolist(), right["other_text"].tolist()
        if key[0] % 2:  # a block with itself
            two = one
            x, y, ratio = similar_in_cell(a, None, least)
        elif len(a[0]) <= len(b[0]):
            x, y, ratio = similar_in_cell(a, b, least)
        else:
            y, x, ratio = similar_in_cell(b, a, least)
        out = pd.DataFrame({"left_id": one[x], "right_id": two[y], "ratio": ratio})
        return out[out["left_id"] != out["right_id"]] if key[0] % 2 else out

    return run


def similar_by_cells(left: DataFrame, right: DataFrame | None, least: float) -> DataFrame:
    """``similar_strings`` of strings of up to ``SEGMENTED`` characters."""
    sides = [t.where(F.length("text") <= SEGMENTED) for t in ([left] if right is None else [left, right])]
    blocks = [{r[0]: -(-r[1] // BLOCK) for r in t.groupBy(F.length("text")).count().collect()} for t in sides]
    one, two, rows = blocks[0], blocks[-1], ([], [])
    number = 0
    for p in sorted(one):
        for q in sorted(two):
            if distance_bound(min(p, q), max(p, q), least) < 0 or (right is None and p > q):
                continue
            for c in range(one[p]):
                for d in range(c if right is None and p == q else 0, two[q]):
                    cell = 2 * number + int(right is None and p == q and c == d)
                    rows[0].append((p, c, cell))
                    rows[1].append((q, d, cell))
                    number += 1
    session, kind = left.sparkSession, (left if right is None else right).schema["id"].dataType
    schema = T.StructType([T.StructField("left_id", left.schema["id"].dataType), T.StructField("right_id", kind), T.StructField("ratio", T.DoubleType())])
    if not number:
        return session.createDataFrame([], schema)
    dealt, times = [], []
    for table, has, cells in zip((sides[0], sides[-1]), (one, two), rows):
        size = F.length("text")
        of = F.element_at(F.create_map(*(F.lit(v) for pair in has.items() for v in pair)), size)
        placed = table.select(size.alias("size"), F.pmod(F.xxhash64("text"), of).cast("int").alias("block"), "id", "text")
        # A few hundred rows: lengths, blocks and cells.
        wanted = session.createDataFrame(cells, "size int, block int, cell int").groupBy("size", "block").agg(F.collect_list("cell").alias("cells"))
        dealt.append(placed.join(F.broadcast(wanted), ["size", "block"]).select(F.explode("cells").alias("cell"), "id", "text"))
        times.append(table.count() * len(cells) // max(1, sum(has.values())))
    # More partitions than cells, as hashes would else put several large cells into one.
    parts = max(1, min(4 * number, max(session.sparkContext.defaultParallelism, sum(times) // DEALT)))
    dealt[1] = dealt[1].toDF("cell", "other_id", "other_text")  # names of its own, as both may come from one table
    near = dealt[0].repartition(parts, "cell").groupBy("cell").cogroup(dealt[1].repartition(parts, "cell").groupBy("cell")).applyInPandas(_cell_of(least), schema)
    return near if right is not None else near.select(F.least("left_id", "right_id").alias("left_id"), F.greatest("left_id", "right_id").alias("right_id"), "ratio")


def long_candidates(left: DataFrame, right: DataFrame | None, least: float) -> DataFrame | None:
    """Candidates of which one string at least has more than ``SEGMENTED`` characters; none if there is no such string."""
    tables = [left] if right is None else [left, right]
    if all(t.where(F.length("text") > SEGMENTED).isEmpty() for t in tables):
        return None
    # A string beyond SEGMENTED with those that may be similar to it.
    near = [t.where(F.length("text") * (200 - least) > SEGMENTED * least) for t in tables]
    frequency = written(_grams(near[0] if right is None else near[0].unionByName(near[1])).groupBy("gram").agg(F.count(F.lit(1)).alias("df")), "grams")
    rare = [_rare_pairs(t, frequency, least) for t in near]
    beyond = [r.where(F.col("size") > SEGMENTED) for r in rare]
    found = _met(beyond[0], rare[-1], "gram")
    return found if right is None else found.unionByName(_met(rare[0], beyond[1], "gram"))


def similar_strings(left: DataFrame, right: DataFrame | None = None, least: float = 85.0) -> DataFrame:
    """(left_id, right_id, ratio) of all pairs of (id, text) with an Indel ratio of ``least`` or more (which is over 0).

    Without ``right``, pairs of the left's rows with left_id < right_id. Null and empty texts are similar to nothing; rows of one id
    should have one text. No pair is lost; only pairs that share a signature are compared.
    """
    left, right = (t if t is None else written(t.where("text is not null AND text <> ''").select("id", "text").distinct(), "strings") for t in (left, right))
    found, pairs = similar_by_cells(left, right, least), long_candidates(left, right, least)
    if pairs is None:
        return found
    pairs = written(_once(pairs, right is None), "candidates")
    a, b = left.select(F.col("id").alias("left_id"), F.col("text").alias("left_text")), (left if right is None else right).select(F.col("id").alias("right_id"), F.col("text").alias("right_text"))
    size, other = F.length("left_text"), F.length("right_text")
    close = pairs.join(a, "left_id").join(b, "right_id").where((F.greatest(size, other) > SEGMENTED) & (200 * F.least(size, other) >= least * (size + other)))
    return found.unionByName(close.select("left_id", "right_id", indel_ratio(F.col("left_text"), F.col("right_text")).alias("ratio")).where(F.col("ratio") >= least))

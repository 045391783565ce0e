"""Quality rules by weak supervision.

Each rule looks at counts of one whole text and votes *good*, *bad* or abstains. Expectation-maximisation over
the vote patterns of all documents estimates how often each rule is right, without labels, and a document is
kept when its posterior probability of being good is high enough. A failed rule therefore does not reject a
document by itself, as all-must-pass filters do.

Bounded memory: a vote pattern is one of 3**len(RULES) codes, so the counts by pattern, the only thing that
reaches the driver, are a table whose size does not depend on the number of documents.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragbench.llm.common import SPACE, Columns, stored

#: name, feature, good if at most, bad if at least (above for good, below for bad where good > bad).
#: A value between the two bounds is an abstention.
RULES = (
    ("symbols", "symbol_ratio", 0.02, 0.10),
    ("repeats", "repeat_share", 0.05, 0.30),
    ("duplicate_lines", "dup_line_share", 0.05, 0.30),
    ("upper_case", "upper_share", 0.15, 0.50),
    ("exclamations", "shout_ratio", 0.05, 0.30),
    ("letters", "letter_share", 0.92, 0.70),
    ("bare_symbols", "bare_share", 0.02, 0.10),
    ("symbol_words", "symbol_word_share", 0.05, 0.30),
    ("word_length_low", "mean_word", 2.5, 1.8),
    ("word_length_high", "mean_word", 12.0, 18.0),
    ("vocabulary", "distinct_share", 0.20, 0.08),
)
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SCHEMA = T.StructType([*(T.StructField(c, T.LongType()) for c in _COUNTS), T.StructField("pattern", T.IntegerType())])
_SPACES, _SYMBOLS = list(SPACE.encode()), list(b"#*$%&|<>")
_PUNCTUATION = bytes(c for c in range(0x80) if not chr(c).isalnum() and c not in _SPACES)
_NOT_SYMBOLS = bytes(c for c in range(0x100) if c not in _SYMBOLS and c not in _SPACES)
#: Base rules of the contract.
MIN_WORDS, MAX_REPEAT_PERCENT, REPEAT_WINDOW = 10, 20, 5


def _ranked(x: np.ndarray) -> tuple[np.ndarray, int]:
    values, ids = np.unique(x, return_inverse=True)
    return ids.astype(np.int64), len(values)


def repeated_words(ids: np.ndarray, window: int = REPEAT_WINDOW) -> int:
    """Words inside windows of consecutive words that occur twice or more, the first occurrence included.

    ``ids`` are word numbers. Windows are numbered exactly (pairs of numbers, renumbered before they could
    overflow), so there are no hash collisions.
    """
    n = len(ids)
    if n <= window:
        return 0
    key, size = ids.astype(np.int64), int(ids.max()) + 1
    base = size
    for k in range(1, window):
        if size * base >= 2**62:
            key, size = _ranked(key)
        key, size = key[:-1] * base + ids[k:], size * base
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    repeated = counts[inverse] > 1
    if not repeated.any():
        return 0
    edges = np.zeros(n + 1, dtype=np.int64)
    starts = np.flatnonzero(repeated)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def measure(text: str | None) -> tuple[dict[str, int], dict[str, float]]:
    """The contract's counts of one whole text, and the ratios that the rules read.

    For the ratios a letter is an ASCII letter or any code point beyond ASCII, and upper case is A-Z.
    """
    text = text or ""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    n = len(words)
    numbers: dict[bytes, int] = {}
    ids = np.fromiter(map(numbers.setdefault, words, itertools.count()), dtype=np.int64, count=n)
    seen = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    chars = int(seen[:0x80].sum() + seen[0xC0:].sum() - seen[_SPACES].sum())
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    counts = {
        "n_words": n,
        "word_chars": chars,
        "n_symbols": int(seen[_SYMBOLS].sum()),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": repeated_words(ids),
    }
    upper = int(seen[0x41:0x5B].sum())
    letters = upper + int(seen[0x61:0x7B].sum() + seen[0xC0:].sum())
    ratios = {
        "symbol_ratio": counts["n_symbols"] / max(n, 1),
        "repeat_share": counts["n_repeat_words"] / max(n, 1),
        "dup_line_share": counts["n_dup_lines"] / max(len(lines), 1),
        "upper_share": upper / max(letters, 1),
        "shout_ratio": int(seen[0x21] + seen[0x3F]) / max(n, 1),
        "letter_share": letters / max(chars, 1),
        # Words are counted again without the bytes that don't matter: those left hold at least one that does.
        "bare_share": 1 - len(raw.translate(None, _PUNCTUATION).split()) / max(n, 1) if n else 0.0,
        "symbol_word_share": len(raw.translate(None, _NOT_SYMBOLS).split()) / max(n, 1),
        "mean_word": chars / max(n, 1),
        # Vocabulary grows slower than length; the square root makes long texts comparable with short ones.
        "distinct_share": len(numbers) / max(n, 1) * math.sqrt(max(n, 100) / 100),
    }
    return counts, ratios


def votes(ratios: dict[str, float]) -> list[int]:
    """1 good, -1 bad, 0 abstention, by rule."""
    out = []
    for _, feature, good, bad in RULES:
        x, sign = ratios[feature], 1 if bad > good else -1
        out.append(1 if sign * x <= sign * good else -1 if sign * x >= sign * bad else 0)
    return out


def encode(vote: list[int]) -> int:
    code = 0
    for v in vote:
        code = code * 3 + v + 1
    return code


def decode(codes: np.ndarray, rules: int) -> np.ndarray:
    """Votes by pattern and rule."""
    powers = 3 ** np.arange(rules - 1, -1, -1)
    return codes[:, None] // powers % 3 - 1


def _measured(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        rows = []
        for text in texts:
            counts, ratios = measure(text)
            rows.append((*counts.values(), encode(votes(ratios)) if counts["n_words"] else -1))
        yield pd.DataFrame(rows, columns=SCHEMA.names)


measured = F.pandas_udf(_measured, SCHEMA)


def fit(patterns: np.ndarray, weights: np.ndarray, rules: int, steps: int = 200, anchor: float = 0.1) -> tuple[float, np.ndarray]:
    """The share of good documents and, by rule, the log-odds that a bad, a missing and a good vote add.

    Naive-Bayes label model: by class and rule, the probabilities of the three votes. It starts from "a document
    with a bad vote is probably bad", and pseudo-documents (``anchor`` times the number of documents, and 20)
    spread as at that start tie the two classes to their meaning: rules that fail together must not take over
    the class from rules that fail alone. They also give the answer on empty and tiny tables.
    """
    votes_ = decode(patterns, rules) if len(patterns) else np.zeros((0, rules), dtype=np.int64)
    onehot = np.stack([votes_ == v for v in (-1, 0, 1)], axis=2).astype(float)  # pattern, rule, vote
    # What is expected without data: 1 document in 10 is bad; each rule sees 1 in 3 of these and is rarely wrong.
    table = np.tile(np.array([[0.35, 0.15, 0.5], [0.01, 0.09, 0.9]])[:, None, :], (1, rules, 1)) * 20
    good = np.where((votes_ < 0).any(1), 0.1, 0.95)

    def mass(share_good: np.ndarray) -> np.ndarray:
        return np.stack([np.einsum("p,prv->rv", w * weights, onehot) for w in (1 - share_good, share_good)])

    def normal(x: np.ndarray) -> np.ndarray:
        return np.clip(x / x.sum(2, keepdims=True), 1e-4, None)

    start = table + anchor * mass(good)
    classes = np.array([2.0, 18.0]) + anchor * np.array([((1 - good) * weights).sum(), (good * weights).sum()])
    fitted, share = normal(table + mass(good)), 0.9
    for _ in range(steps):
        logs = np.einsum("prv,crv->pc", onehot, np.log(fitted)) + np.log([1 - share, share])
        good = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -500, 500)))
        new, n = normal(start + mass(good)), classes + np.array([((1 - good) * weights).sum(), (good * weights).sum()])
        moved, fitted, share = abs(new - fitted).max() + abs(n[1] / n.sum() - share), new, n[1] / n.sum()
        if moved < 1e-9:
            break
    return float(share), np.log(fitted[1]) - np.log(fitted[0])


def posterior(pattern: Column, share: float, odds: np.ndarray) -> Column:
    """Posterior probability of good for a pattern code; null for the code of a text without words."""
    logit = F.lit(float(np.log(share) - np.log1p(-share)))
    rules = len(odds)
    for r in range(rules):
        vote = F.floor(pattern / (3 ** (rules - 1 - r))).cast("int") % 3
        logit = logit + F.when(vote == 0, float(odds[r, 0])).when(vote == 2, float(odds[r, 2])).otherwise(float(odds[r, 1]))
    return F.when(pattern >= 0, 1 / (1 + F.exp(-logit)))


def score_quality(docs: DataFrame, text: str = "text", threshold: float = 0.5, keep_text: bool = True) -> DataFrame:
    """Add the counts, ``base_failed``, ``posterior`` and ``kept`` to every row; all columns stay.

    Null and empty texts have zero words: they fail the base rules. Repeated rows are separate documents and
    get equal verdicts. An input column with the name of an output is replaced, all others stay, whatever their
    names. An empty table gives an empty table. Any text length is taken whole. The measured table is written to the
    shared folder, since it is read twice: for the counts by pattern and for the verdicts; ``keep_text=False`` leaves
    the text out of it.
    """
    table = Columns(docs)
    content = table.name(text)
    keep = [c for c in table.rows.columns if keep_text or c != content]
    rows = stored(table.rows.select(*keep, measured(F.col(content)).alias("m")), "quality")
    found = rows.select("m.pattern").where("pattern >= 0").groupBy("pattern").count().orderBy("pattern").collect()
    # At most 3 ** len(RULES) rows, whatever the number of documents.
    share, odds = fit(np.array([r[0] for r in found], dtype=np.int64), np.array([r[1] for r in found], dtype=float), len(RULES))
    failed = (F.col("m.n_words") < MIN_WORDS) | (100 * F.col("m.n_repeat_words") > MAX_REPEAT_PERCENT * F.col("m.n_words"))
    p = posterior(F.col("m.pattern"), share, odds)
    outputs = {c: f"m.{c}" for c in _COUNTS} | {"base_failed": failed, "posterior": p, "kept": ~failed & F.coalesce(p >= threshold, F.lit(False))}
    return table.done(rows, outputs, without=() if keep_text else (text,))


def op4_quality_rules(docs: DataFrame) -> DataFrame:
    """Contract of the query: a digest of :func:`score_quality` by document."""
    return score_quality(docs.select("doc_id", "text"), keep_text=False).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior"
    )

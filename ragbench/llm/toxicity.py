"""Toxicity classifier with a counterfactual penalty.

A logistic model over the words of a text, and the beginnings of words (inflected and compound forms), whose
spread over toxic and clean texts chance does not explain. In every labelled sentence that names an identity term, the term
is swapped for each other term of its group, seen in the sample or not, and the squared change of the score (by the word
and the beginnings of words that come and go with it) is penalised. Terms for groups of
people so get nearly equal weights within a group whatever company they keep in the sample, and a neutral mention
does not raise the score.

The model is fitted in numpy on a bounded sample of labelled documents (at most ``max_toxic`` and ``max_clean``
rows, chosen by a hash of the id); scoring covers every whole text in Arrow batches.
"""

from __future__ import annotations

import logging
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragbench.llm.common import Columns, held_out, stored

#: Interchangeable terms for groups of people.
IDENTITY_GROUPS = (
    ("women", "men", "girls", "boys", "mujeres", "hombres", "femmes", "hommes", "frauen", "männer"),
    ("woman", "man", "girl", "boy", "mujer", "hombre", "femme", "homme", "frau", "mann"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "catholic", "atheist", "sikh"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "catholics", "atheists", "sikhs"),
    ("black", "white", "asian", "latino", "african", "arab", "european", "indigenous"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "queer", "heterosexual"),
    ("immigrant", "refugee", "foreigner", "native", "inmigrante", "réfugié", "flüchtling"),
    ("deaf", "blind", "disabled", "autistic", "elderly", "young"),
)
MAX_TOXIC, MAX_CLEAN = 4000, 8000
#: A feature of the model stands in LEAST_DF documents of the sample or more, is spread over the classes as chance
#: does with a probability under CHANCE, and is among the MOST_TERMS surest ones.
LEAST_DF, CHANCE, MOST_TERMS = 3, 5e-5, 500
#: Bytes of a text that are letters (A-Z in lower case) or beyond ASCII; all others separate words.
_NORMAL = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(0x100))
#: Bytes of the beginnings of words that are features.
PREFIXES = (4, 5, 6, 7, 8, 9)
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n")
_LOG = logging.getLogger(__name__)
_GROUP_OF = {term.encode(): no for no, group in enumerate(IDENTITY_GROUPS) for term in group}


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_NORMAL).split()


def features_of(text: str | None, sizes: Iterable[int] = PREFIXES) -> set[bytes]:
    """Distinct words, and the first bytes of longer words, marked with ^."""
    words = set(words_of(text))
    return words.union(*({b"^" + w[:k] for w in words if len(w) > k} for k in sizes))


#: The features of all terms of each group.
_FAMILIES = [set().union(*(features_of(term) for term in group)) for group in IDENTITY_GROUPS]


def swaps_of(text: str | None) -> list[bytes]:
    """The identity terms of a text, once for each sentence that holds them.

    After the term, set off by spaces, come the features of its group's terms that the sentence's other words have
    too, as a swap does not change those.
    """
    found: list[bytes] = []
    if not _GROUP_OF.keys().isdisjoint(words_of(text)):
        for sentence in _SENTENCE.split(text or ""):
            words = set(words_of(sentence))
            for term in sorted(_GROUP_OF.keys() & words):
                kept = features_of(b" ".join(words - {term}).decode("utf-8", "replace")) & _FAMILIES[_GROUP_OF[term]]
                found.append(b" ".join([term, *sorted(kept)]))
    return found


def log_chance(k: int, m: int, rate: float, steps: np.ndarray) -> float:
    """Log of the probability that chance alone puts a feature of m documents into k toxic ones, or further from ``rate``.

    Exact binomial tail on the side where k lies; 0 where k is within a standard deviation. ``steps`` are the logs
    of the factorials.
    """
    if abs(k - m * rate) <= np.sqrt(m * rate * (1 - rate)):
        return 0.0
    if k < m * rate:
        k, rate = m - k, 1 - rate
    i = np.arange(k, m + 1)
    terms = steps[m] - steps[i] - steps[m - i] + i * np.log(rate) + (m - i) * np.log1p(-rate)
    return float(terms.max() + np.log(np.exp(terms - terms.max()).sum()))


def log_factorials(n: int) -> np.ndarray:
    return np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, n + 1)))))


def fit(samples: list[tuple[set[bytes], int]], swaps: Counter, terms: list[bytes], l2: float = 0.1, swap_weight: float = 10.0, steps: int = 50) -> tuple[float, dict[bytes, float]]:
    """Intercept and weights of ``terms``: Newton steps on logistic loss, an L2 penalty and the swap penalty.

    ``swaps`` counts labelled sentences by identity term (and kept features, see ``swaps_of``). The penalty is the
    mean over all other terms of the group of the squared change of the score when the term is swapped, weighted by
    that count: the features of the one go, those of the other come, and what is not in ``terms`` weighs nothing. Without samples, or with one class only, the smoothed base rate is every score.
    """
    y = np.array([label for _, label in samples], dtype=float)
    n, n1 = len(y), y.sum()
    base = float(np.log((n1 + 1) / (n - n1 + 1)))
    if n1 == 0 or n1 == n:
        return base, {}
    index = {w: k + 1 for k, w in enumerate(terms)}
    x = np.zeros((n, len(terms) + 1), dtype=np.float32)
    x[:, 0] = 1
    for row, (words, _) in enumerate(samples):
        x[row, [index[w] for w in words & index.keys()]] = 1
    # Documents of both classes weigh the same, so that rare toxic rows count.
    weight = np.where(y == 1, n / (2 * n1), n / (2 * (n - n1)))
    penalty = l2 * np.eye(len(terms) + 1)
    penalty[0, 0] = 1e-6
    for swap, count in swaps.items():
        term, *kept = swap.split()
        group = [t for t in IDENTITY_GROUPS[_GROUP_OF[term]] if t.encode() != term]
        for other in group:
            gone, come = features_of(term.decode()) - set(kept), features_of(other) - set(kept)
            at = [index[f] for f in sorted((gone ^ come) & index.keys())]
            d = np.array([1.0 if f in gone else -1.0 for f in sorted((gone ^ come) & index.keys())])
            penalty[np.ix_(at, at)] += swap_weight * count / len(group) * np.outer(d, d)
    w = np.zeros(len(terms) + 1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + penalty @ w
        curve = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + penalty
        step = np.linalg.solve(curve, slope)
        step *= min(1.0, 5.0 / max(abs(step).max(), 1e-12))
        w -= step
        if abs(step).max() < 1e-8:
            break
    return float(w[0]), {t: float(w[k]) for t, k in index.items()}


def learn(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> tuple[float, dict[bytes, float]]:
    """Fit on labelled rows that are not held out. Of several labels of a document the largest counts; null labels don't."""
    usable = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = (F.md5(F.col("doc_id").cast("string").cast("binary")), F.col("doc_id"))
    chosen = usable.where("toxic = 1").orderBy(*order).limit(max_toxic).unionByName(usable.where("toxic = 0").orderBy(*order).limit(max_clean))
    # At most max_toxic + max_clean narrow rows; of rows that repeat an id the text with the greatest hash is taken.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    sample = stored(rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max_by("text", F.xxhash64("text")).alias("text")).select("toxic", "text"), "sample")
    sizes = {r[0]: r[1] for r in sample.groupBy("toxic").count().collect()}
    n, n1 = sum(sizes.values()), sizes.get(1, 0)
    terms: list[bytes] = []
    if 0 < n1 < n:
        steps, rate = log_factorials(n), n1 / n

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for at in range(0, len(batch), 500):
                    df, hits = Counter(), Counter()
                    for text, toxic in zip(batch["text"].iloc[at : at + 500], batch["toxic"].iloc[at : at + 500]):
                        found = features_of(text)
                        df.update(found)
                        if toxic:
                            hits.update(found)
                    yield pd.DataFrame({"feature": list(df), "m": list(df.values()), "k": [hits[w] for w in df]})

        def chance(k: pd.Series, m: pd.Series) -> pd.Series:
            return pd.Series([log_chance(int(a), int(b), rate, steps) for a, b in zip(k, m)], dtype=float)

        counts = sample.mapInPandas(count, "feature binary, m long, k long").groupBy("feature").agg(F.sum("m").alias("m"), F.sum("k").alias("k"))
        odd = counts.where(F.col("m") >= LEAST_DF).withColumn("p", F.pandas_udf(chance, T.DoubleType())("k", "m")).where(F.col("p") < float(np.log(CHANCE)))
        terms = [bytes(r[0]) for r in odd.orderBy("p", "feature").limit(MOST_TERMS).select("feature").collect()]
    known = sorted(set(terms) | _GROUP_OF.keys())

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted = set(known)
        for batch in batches:
            yield pd.DataFrame({
                "toxic": batch["toxic"], "words": [b" ".join(sorted(wanted & features_of(t))) for t in batch["text"]], "swaps": [b"\n".join(swaps_of(t)) for t in batch["text"]],
            })

    found = sample.mapInPandas(keep, "toxic int, words binary, swaps binary").collect()  # of each document the chosen features only
    samples = sorted(((set(bytes(r["words"]).split()), r["toxic"]) for r in found), key=lambda x: (sorted(x[0]), x[1]))
    present = set().union(*(w for w, _ in samples)) if samples else set()
    swaps = Counter(w for r in found for w in bytes(r["swaps"]).splitlines())
    _LOG.info("toxicity: %d labelled documents, %d swapped sentences", len(samples), sum(swaps.values()))
    return fit(samples, swaps, sorted(present & set(known)))


def score_toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> DataFrame:
    """Add ``held_out``, ``score`` and ``predicted`` to every row; all other columns stay.

    Only the text is an input of a score. Null and empty texts get the intercept's score. Repeated rows are scored
    alike. Columns named like outputs are replaced, all others stay, whatever their names. An empty table of documents
    gives an empty table; without usable labels the score is 0.5 for all. Texts are read whole, whatever their length.
    Labels without a doc_id, or with one that no document has, are not used.
    """
    table = Columns(docs)
    text, doc_id = table.name(text), table.name(doc_id)
    intercept, weights = learn(table.rows.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), labels, max_toxic, max_clean)
    model = docs.sparkSession.sparkContext.broadcast((intercept, weights))  # at most the sample's vocabulary; a few hundred words

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        b, w = model.value
        sizes = sorted({len(x) - 1 for x in w if x[:1] == b"^"})
        for texts in batches:
            z = np.array([b + sum(w[x] for x in w.keys() & features_of(t, sizes)) for t in texts], dtype=float)
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -40, 40))))

    scored = table.rows.withColumn("score", F.pandas_udf(run, T.DoubleType())(F.col(text)))
    return table.done(scored, {"held_out": held_out(F.col(doc_id)), "score": "score", "predicted": (F.col("score") >= 0.5).cast("int")})


def op1_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Contract of the query."""
    return score_toxicity(docs.select("doc_id", "text"), labels).select("doc_id", "held_out", "score", "predicted")

"""Language identification by a bidirectional gated recurrent network over bytes.

A sequence is a word (letters in lower case and non-ASCII bytes; longer words in pieces of ``PIECE`` bytes). Each
position's forward and backward states give probabilities of the languages; a document's probabilities pool the
log-probabilities of all its positions. As the network starts anew at each word, equal words have equal labels:
a task runs each distinct word once and keeps the answer, so a long text costs little more than its vocabulary.

Training is backpropagation through time in numpy, on the driver, over a bounded sample of documents.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragbench.llm.common import Columns, held_out

HIDDEN, PIECE, FLOOR, STEPS = 24, 24, 1e-3, 700
#: Bounds of the training sample: documents of a language, and distinct words of all languages (each has an equal part).
DOCS_PER_LANGUAGE, MAX_PAIRS = 400, 200_000
#: Words whose answers a worker keeps.
MAX_KEPT = 300_000
_NORMAL = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(0x100))


def pieces_of(text: str | None) -> list[bytes]:
    words = (text or "").encode("utf-8", "replace").translate(_NORMAL).split()
    if words and max(map(len, words)) > PIECE:
        words = [piece for w in words for piece in _cut(w)]
    return words


def _cut(word: bytes) -> list[bytes]:
    """Pieces of at most PIECE bytes, never within a character."""
    out, at = [], 0
    while at < len(word):
        end = min(at + PIECE, len(word))
        while end < len(word) and end > at + 1 and 0x80 <= word[end] < 0xC0:
            end -= 1
        out.append(word[at:end])
        at = end
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class ByteTagger:
    """Two GRUs (forward, backward) over bytes and a softmax at each position. All parameters are float32."""

    def __init__(self, classes: int, hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.hidden, self.classes = hidden, classes
        self.p: dict[str, np.ndarray] = {}
        for d in "fb":
            self.p[f"x{d}"] = rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)
            self.p[f"h{d}"] = (rng.normal(0, 1, (hidden, 3 * hidden)) / np.sqrt(hidden)).astype(np.float32)
            self.p[f"c{d}"] = np.zeros(3 * hidden, dtype=np.float32)
        self.p["o"] = (rng.normal(0, 1, (2 * hidden, classes)) / np.sqrt(2 * hidden)).astype(np.float32)
        self.p["q"] = np.zeros(classes, dtype=np.float32)

    def _run(self, d: str, seq: np.ndarray, mask: np.ndarray | None, keep: list | None) -> np.ndarray:
        """States by position. Update gate z, reset gate r, candidate n: h' = z*h + (1-z)*n."""
        k, (rows, steps) = self.hidden, seq.shape
        wx, wh, c = self.p[f"x{d}"], self.p[f"h{d}"], self.p[f"c{d}"]
        h, out = np.zeros((rows, k), dtype=np.float32), np.empty((steps, rows, k), dtype=np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            a, u = wx[seq[:, t]] + c, h @ wh
            gates = _sigmoid(a[:, : 2 * k] + u[:, : 2 * k])
            z, r = gates[:, :k], gates[:, k:]
            n = np.tanh(a[:, 2 * k :] + r * u[:, 2 * k :])
            new = n + z * (h - n)
            if mask is not None:
                new = np.where(mask[:, t, None], new, h)
            if keep is not None:
                keep.append((t, h, z, r, n, u[:, 2 * k :]))
            h = new
            out[t] = h
        return out

    def log_probs(self, seq: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
        """(position, row, class)."""
        states = np.concatenate([self._run("f", seq, mask, None), self._run("b", seq, mask, None)], axis=2)
        logits = states @ self.p["o"] + self.p["q"]
        logits -= logits.max(2, keepdims=True)
        return logits - np.log(np.exp(logits).sum(2, keepdims=True))

    def gradients(self, seq: np.ndarray, mask: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy of all positions to their row's target distribution, and its gradients through time."""
        k = self.hidden
        kept: dict[str, list] = {"f": [], "b": []}
        states = np.concatenate([self._run(d, seq, mask, kept[d]) for d in "fb"], axis=2)
        logits = states @ self.p["o"] + self.p["q"]
        logits -= logits.max(2, keepdims=True)
        logp = logits - np.log(np.exp(logits).sum(2, keepdims=True))
        share = (mask * (weight / mask.sum(1))[:, None]).T[:, :, None] / weight.sum()
        loss = float(-(share * target[None] * logp).sum())
        dlogits = (np.exp(logp) - target[None]) * share
        g = {"o": np.tensordot(states, dlogits, ([0, 1], [0, 1])), "q": dlogits.sum((0, 1))}
        dstates = dlogits @ self.p["o"].T
        for no, d in enumerate("fb"):
            wh = self.p[f"h{d}"]
            gx, gh, gc = np.zeros_like(self.p[f"x{d}"]), np.zeros_like(wh), np.zeros_like(self.p[f"c{d}"])
            back = np.zeros((seq.shape[0], k), dtype=np.float32)
            for t, h, z, r, n, un in reversed(kept[d]):
                dh = back + dstates[t, :, no * k : (no + 1) * k]
                live = mask[:, t, None]
                da_n = dh * (1 - z) * (1 - n * n) * live
                da_z = dh * (h - n) * z * (1 - z) * live
                da_r = da_n * un * r * (1 - r)
                da = np.concatenate([da_z, da_r, da_n], axis=1)
                du = np.concatenate([da_z, da_r, da_n * r], axis=1)
                np.add.at(gx, seq[:, t], da)
                gc += da.sum(0)
                gh += h.T @ du
                back = np.where(live, dh * z, dh) + du @ wh.T
            g |= {f"x{d}": gx, f"h{d}": gh, f"c{d}": gc}
        return loss, g


def padded(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(w) for w in words])
    mask = np.arange(size.max())[None] < size[:, None]
    seq = np.zeros(mask.shape, dtype=np.uint8)
    seq[mask] = np.frombuffer(b"".join(words), dtype=np.uint8)
    return seq, mask


def train(words: list[bytes], counts: np.ndarray, steps: int | None = None, batch: int = 256, rate: float = 0.01, seed: int = 11, hidden: int = HIDDEN) -> ByteTagger:
    """Fit on distinct words; ``counts`` has a row for each and a column for each language.

    A word's target is its share of each language (languages weigh the same); words are drawn by the root of
    their frequency. Adam with a falling rate.
    """
    model, steps = ByteTagger(counts.shape[1], hidden), steps or STEPS
    share = counts / np.maximum(counts.sum(0, keepdims=True), 1)
    target = (share / share.sum(1, keepdims=True)).astype(np.float32)
    draw = np.sqrt(share.sum(1))
    draw /= draw.sum()
    rng = np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in model.p.items()}
    second = {k: np.zeros_like(v) for k, v in model.p.items()}
    for step in range(1, steps + 1):
        rows = rng.choice(len(words), size=batch, p=draw)
        seq, mask = padded([words[i] for i in rows])
        _, g = model.gradients(seq, mask, target[rows], np.ones(batch, dtype=np.float32))
        norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
        scale, lr = min(1.0, 1.0 / max(norm, 1e-9)), rate * (1 - step / (steps + 1)) ** 0.5
        for k, v in g.items():
            v = v * scale
            first[k] += 0.1 * (v - first[k])
            second[k] += 0.001 * (v * v - second[k])
            model.p[k] -= lr * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


def word_log_probs(model: ByteTagger, words: list[bytes], floor: float = FLOOR) -> np.ndarray:
    """By word, the sum over its positions of the log-probabilities (not under ``floor``); words of a length run together."""
    out = np.empty((len(words), model.classes), dtype=np.float32)
    size = np.array([len(w) for w in words])
    for k in np.unique(size):
        rows = np.flatnonzero(size == k)
        for at in range(0, len(rows), 4096):
            part = rows[at : at + 4096]
            seq = np.frombuffer(b"".join([words[i] for i in part]), dtype=np.uint8).reshape(len(part), k)
            out[part] = np.maximum(model.log_probs(seq), np.log(floor)).sum(0)
    return out


class Pooler:
    """A model with the answers for words seen so far (at most MAX_KEPT of them)."""

    def __init__(self, model: ByteTagger, languages: list[str]):
        self.model, self.languages = model, languages
        self.reset()

    def reset(self) -> None:
        self.index: dict[bytes, int] = {}
        self.table = np.zeros((0, len(self.languages)), dtype=np.float32)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        split = [pieces_of(t) for t in texts]
        if len(self.index) > MAX_KEPT:
            self.reset()
        new = [w for w in dict.fromkeys(itertools.chain.from_iterable(split)) if w not in self.index]
        if new:
            self.index |= zip(new, range(len(self.index), len(self.index) + len(new)))
            self.table = np.concatenate([self.table, word_log_probs(self.model, new)])
        langs, scores = [], []
        for text, words in zip(texts, split):
            if not words or not (any(0x61 <= c <= 0x7A for w in words for c in w) or any(map(str.isalpha, text))):
                langs.append("und")
                scores.append(0.0)
                continue
            total = self.table[np.fromiter(map(self.index.__getitem__, words), dtype=np.int64, count=len(words))].sum(0, dtype=np.float64)
            mean = total / sum(map(len, words))
            p = np.exp(mean - mean.max())
            best = int(p.argmax())
            langs.append(self.languages[best])
            scores.append(float(p[best] / p.sum()))
        return langs, scores


_POOLERS: dict[str, Pooler] = {}
SCHEMA = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", per_language: int = DOCS_PER_LANGUAGE, max_pairs: int = MAX_PAIRS) -> tuple[ByteTagger, list[str]] | None:
    """Fit on rows with a language that are not held out; None without such rows."""
    rows = docs.where(~held_out(F.col(doc_id)) & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}  # one row for each language
    if not sizes:
        return None
    # A hash of the id decides, at a rate that leaves about twice the wanted number; the rest is cut by rank.
    even = F.pmod(F.xxhash64("id"), F.lit(1_000_000))
    rate = F.element_at(F.create_map(*itertools.chain.from_iterable((F.lit(k), F.lit(min(1_000_000, int(2e6 * per_language / n) + 1))) for k, n in sizes.items())), F.col("lang"))
    sample = rows.where(even <= rate).withColumn("no", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id", "text"))).where(F.col("no") <= per_language)

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for language, text_ in zip(batch["lang"], batch["text"]):
                yield pd.DataFrame({"lang": language, "word": pieces_of(text_)})

    pairs = sample.select("lang", "text").mapInPandas(words, "lang string, word binary").groupBy("lang", "word").count()
    # Every language keeps its most frequent words, however rare it is among the documents.
    order = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("count"), F.xxhash64("word"), "word"))
    found = pairs.withColumn("no", order).where(F.col("no") <= max(1, max_pairs // len(sizes))).select("lang", "word", "count").collect()
    languages = sorted({r[0] for r in found})
    vocabulary = {w: k for k, w in enumerate(sorted({bytes(r[1]) for r in found}))}
    if not vocabulary:
        return None
    counts = np.zeros((len(vocabulary), len(languages)))
    for language, word, n in found:
        counts[vocabulary[bytes(word)], languages.index(language)] += n
    return train(list(vocabulary), counts), languages


def identify(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """Add ``held_out``, ``lang_pred`` and ``score`` to every row; all other columns stay.

    Texts that are null or have no letter get ``und`` with score 0, as do all texts when there is nothing to learn
    from. Repeated rows get equal answers. Columns named like outputs are replaced, all others stay, whatever their
    names. An empty table gives an empty table. All bytes of a text count, whatever its length. Ties go to the
    language that is first by name.
    """
    learned = learn(docs, text, lang, doc_id)
    table = Columns(docs)
    text, doc_id = table.name(text), table.name(doc_id)
    held = held_out(F.col(doc_id))
    if learned is None:
        return table.done(table.rows, {"held_out": held, "lang_pred": F.lit("und"), "score": F.lit(0.0)})
    shared = docs.sparkSession.sparkContext.broadcast(learned)  # some 100 kB
    key = uuid.uuid4().hex

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        pooler = _POOLERS.get(key)
        if pooler is None:
            _POOLERS.clear()
            pooler = _POOLERS[key] = Pooler(*shared.value)
        for texts in batches:
            langs, scores = [], []
            for at in range(0, len(texts), 500):
                found = pooler.predict(list(texts.iloc[at : at + 500]))
                langs += found[0]
                scores += found[1]
            yield pd.DataFrame({"lang_pred": pd.Series(langs, dtype=object), "score": pd.Series(scores, dtype=float)})

    rows = table.rows.withColumn("p", F.pandas_udf(run, SCHEMA)(F.col(text)))
    return table.done(rows, {"held_out": held, "lang_pred": "p.lang_pred", "score": "p.score"})


def op3_language(docs: DataFrame) -> DataFrame:
    """Contract of the query."""
    return identify(docs.select("doc_id", "text", "lang")).select("doc_id", "held_out", "lang_pred", "score")

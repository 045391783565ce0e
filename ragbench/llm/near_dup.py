"""Near-duplicate documents by SetSketch registers, joint likelihood estimates and exact verification.

1. Each text's set of word shingles is reduced to registers: the least of the shingles' exponential hash values,
   for each of 160 hash functions, on an exponentially spaced and truncated scale. Registers of a union are the
   greatest of the parts' registers (:func:`merge`), and two sets agree in a register with a probability of
   about their Jaccard similarity.
2. Texts with equal words form a class, whose document with the smallest id stands for it.
3. Bands of five registers are bucketed. In each bucket, every class is paired with the bucket's smallest id.
4. A pair's similarity is estimated by likelihood from the register orders and the known set sizes; pairs that
   can't reach the threshold are dropped, the others are verified on their full shingle sets.
5. Links give components. Buckets whose classes are still in several components are taken up again: each class
   outside the bucket's largest component meets all classes of other components there, in blocks of a bounded
   number of classes (:func:`_crossings`), so that only pairs that are similar enough become rows. After that,
   every two classes that share a bucket are connected or have been compared: no link is lost to the choice of
   pairs, and a bucket of near copies, however large, costs one pair for each member.

Two sets with a similarity of 0.8 share no bucket with a probability of (1 - 0.8**5)**32 = 3e-6 (less above it).
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragbench.llm.common import Columns, stored
from ragbench.llm.components import components

REGISTERS, BAND = 160, 5
BASE, RATE, TOP = 1.001, 20.0, 65535
#: A pair with an estimate below is not verified: six standard deviations (0.032) under 0.8.
LEAST_ESTIMATE = 0.6
_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(0x100))
_CHUNK = 512
SCHEMA = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("sketch", T.BinaryType())])


def _constants(n: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 2**64, n, dtype=np.uint64)


_XOR, _MUL = _constants(REGISTERS, 1), _constants(REGISTERS, 2) | np.uint64(1)
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def words_of(text: str | None) -> list[bytes]:
    """Words between white space, A-Z in lower case."""
    return (text or "").encode("utf-8", "replace").translate(_LOWER).split()


def shingles(words: list[bytes], size: int) -> set[tuple[bytes, ...]]:
    """Distinct runs of ``size`` words; fewer words are one shingle; no words, no shingle."""
    if len(words) < size:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(size))))


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """A 64-bit hash of each distinct shingle. Distinctness is exact (word numbers), only the values are hashed."""
    n = len(words)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    numbers: dict[bytes, int] = {}
    ids = np.fromiter(map(numbers.setdefault, words, itertools.count()), dtype=np.int64, count=n)
    hashes = np.zeros(n, dtype=np.uint64)
    hashes[np.fromiter(numbers.values(), dtype=np.int64, count=len(numbers))] = [xxhash.xxh3_64_intdigest(w) for w in numbers]
    hashes = hashes[ids]
    width = min(size, n)
    key, span, value = ids, n, hashes
    for k in range(1, width):
        if span * n >= 2**62:
            values, key = np.unique(key, return_inverse=True)
            span = len(values)
        key, span = key[:-1] * n + ids[k:], span * n
        value = (value[:-1] * _STEP ^ (value[:-1] >> np.uint64(29))) + hashes[k:]
    _, first = np.unique(key, return_index=True)
    value = (value[first] + np.uint64(width)) * _MIX
    return (value ^ (value >> np.uint64(31))) * _STEP


def registers(hashes: np.ndarray) -> np.ndarray:
    """SetSketch registers of a set of 64-bit hashes (all 0 for the empty set)."""
    if not len(hashes):
        return np.zeros(REGISTERS, dtype=np.uint16)
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), _CHUNK):
        block = hashes[at : at + _CHUNK, None] ^ _XOR
        block *= _MUL
        np.minimum(least, block.min(axis=0), out=least)
    uniform = (least.astype(np.float64) + 1.0) / 2.0**64
    exponential = -np.log1p(-np.minimum(uniform, 1 - 1e-16)) / RATE
    return np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)), 0, TOP).astype(np.uint16)


def merge(*sketches: np.ndarray) -> np.ndarray:
    """The registers of the union of sets."""
    return np.maximum.reduce(sketches)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity by row, from the registers' order and the exact set sizes."""
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    grid = np.linspace(0, 1, 101)[None, :] * np.minimum(u / v, v / u)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    above, below = p(u - v * grid), p(v - u * grid)
    more, less = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    tiny = 1e-12
    fit = more * np.log(above + tiny) + less * np.log(below + tiny) + (a.shape[1] - more - less) * np.log(np.clip(1 - above - below, tiny, 1))
    return np.take_along_axis(grid, fit.argmax(1)[:, None], 1)[:, 0]


def _sketched(size: int):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for text in texts:
                words = words_of(text)
                hashes = shingle_hashes(words, size)
                rows.append((xxhash.xxh3_128_digest(b" ".join(words)), len(hashes), registers(hashes).tobytes()) if words else (None, 0, None))
            yield pd.DataFrame(rows, columns=SCHEMA.names)

    return F.pandas_udf(run, SCHEMA)


def _stack(sketches: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(sketches), dtype=np.uint16).reshape(len(sketches), REGISTERS)


def _band_hashes(sketches: pd.Series) -> pd.Series:
    bands = _stack(sketches).reshape(len(sketches), REGISTERS // BAND, BAND).astype(np.uint64)
    out = np.broadcast_to(np.arange(1, REGISTERS // BAND + 1, dtype=np.uint64), bands.shape[:2]) * _MIX
    for k in range(BAND):
        out = (out ^ bands[:, :, k]) * _STEP
        out = out ^ (out >> np.uint64(32))
    return pd.Series(list(out.astype(np.int64)))


def _estimates(a: pd.Series, b: pd.Series, n_a: pd.Series, n_b: pd.Series) -> pd.Series:
    x, y, p, q = _stack(a), _stack(b), n_a.to_numpy(float), n_b.to_numpy(float)
    step = 2000
    return pd.Series(np.concatenate([estimate(x[i : i + step], y[i : i + step], p[i : i + step], q[i : i + step]) for i in range(0, len(a), step)] or [np.zeros(0)]))


def _linked(size: int, percent: int):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        out, held, last = [], set(), None
        for x, y in zip(a, b):
            if x is not last:
                held, last = shingles(words_of(x), size), x
            other = shingles(words_of(y), size)
            both = len(held & other)
            out.append(both > 0 and 100 * both >= percent * (len(held) + len(other) - both))
        return pd.Series(out, dtype=bool)

    return F.pandas_udf(run, T.BooleanType())


def _likely(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that set sizes and the estimate don't rule out."""
    left = sketches.select(F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("s_a"))
    right = sketches.select(F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("s_b"))
    estimated = F.pandas_udf(_estimates, T.DoubleType())
    sized = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").where(F.least("n_a", "n_b") * 100 >= percent * F.greatest("n_a", "n_b"))
    return sized.where(estimated("s_a", "s_b", "n_a", "n_b") >= LEAST_ESTIMATE).select("a", "b")


def _verified(likely: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""
    likely = stored(likely, "likely")
    needed = likely.select(F.col("a").alias("id")).unionByName(likely.select(F.col("b").alias("id"))).distinct()
    held = stored(texts.join(stored(needed, "needed"), "id", "left_semi").dropDuplicates(["id"]), "texts")
    both = likely.join(held.select(F.col("id").alias("b"), F.col("text").alias("t_b")).hint("merge"), "b")
    both = both.join(held.select(F.col("id").alias("a"), F.col("text").alias("t_a")).hint("merge"), "a")
    return stored(both.where(_linked(size, percent)("t_a", "t_b")).select("a", "b").distinct(), "links")


def _short_hashes(size: int):
    """The sorted 32-bit hashes of a text's shingles."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([np.sort((shingle_hashes(words_of(t), size) >> np.uint64(32)).astype(np.uint32)).tobytes() for t in texts])

    return F.pandas_udf(run, T.BinaryType())


#: Classes of a bucket that meet at once: those outside its largest component, and all.
FEW_BLOCK, ALL_BLOCK = 64, 128


def _crossings(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that share a bucket and whose hashed shingle sets are similar enough.

    ``members`` has band, k (classes in the bucket), few (outside the largest component), rep, label, n, sketch
    and hashes. A bucket's classes are dealt to blocks by a hash, and each block of the few meets each block of
    all: first as numbers of blocks, which carry nothing else, then the blocks' contents are joined to them by bucket
    and block, so that a large bucket is split over as many keys as it has blocks. Similarities are worked out in
    numpy. 32-bit hashes may meet by chance, so a little less than the threshold passes; the pairs are verified on the
    texts afterwards. A pair counts in its first common bucket.
    """
    id_type = members.schema["rep"].dataType.simpleString()
    fields, bucket = ("rep", "label", "n", "sketch", "hashes"), ["band", "place"]

    def blocks(rows: DataFrame, least: int, prefix: str) -> DataFrame:
        block = F.pmod(F.xxhash64("rep"), F.ceil(F.col("k") / least))
        grouped = rows.groupBy(*bucket, block.alias(prefix)).agg(F.first("k").alias("k"), F.collect_list(F.struct(*fields)).alias("c"))
        return grouped.select(*bucket, prefix, "k", *(F.col(f"c.{f}").alias(f"{prefix}_{f}") for f in fields))

    few, everyone = blocks(members.where("few"), FEW_BLOCK, "x"), blocks(members, ALL_BLOCK, "y").drop("k")
    meeting = few.select(*bucket, "x", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("k") / ALL_BLOCK) - 1)).alias("y"))
    met = meeting.hint("merge").join(everyone.hint("merge"), [*bucket, "y"]).join(few.drop("k").hint("merge"), [*bucket, "x"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                n_y, sets_y = np.asarray(row.y_n), [np.frombuffer(h, dtype=np.uint32) for h in row.y_hashes]
                sketch_y, label_y = _stack(row.y_sketch), np.asarray(row.y_label)
                for rep, label, n, sketch, hashes in zip(row.x_rep, row.x_label, row.x_n, row.x_sketch, row.x_hashes):
                    same = sketch_y == np.frombuffer(sketch, dtype=np.uint16)
                    first = same.reshape(len(sketch_y), -1, BAND).all(2).argmax(1) == row.place
                    sized = 100 * np.minimum(n, n_y) >= percent * np.maximum(n, n_y)
                    todo = np.flatnonzero(first & sized & (label_y != label) & (same.sum(1) >= LEAST_ESTIMATE * REGISTERS))
                    if not len(todo):
                        continue
                    own = np.frombuffer(hashes, dtype=np.uint32)
                    others = np.concatenate([sets_y[k] for k in todo])
                    at = np.minimum(np.searchsorted(own, others), len(own) - 1)
                    starts = np.concatenate(([0], np.cumsum([len(sets_y[k]) for k in todo])[:-1]))
                    both = np.add.reduceat((own[at] == others).astype(np.int64), starts)
                    for k in todo[100 * both >= (percent - 1) * (n + n_y[todo] - both)]:
                        out.append((min(rep, row.y_rep[k]), max(rep, row.y_rep[k])))
            yield pd.DataFrame(out, columns=["a", "b"])

    return met.drop("band", "x", "y").mapInPandas(run, f"a {id_type}, b {id_type}").distinct()


def near_duplicate_rows(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = 5, percent: int = 80) -> DataFrame:
    """(id, n, component) for each row: its shingles and the smallest id reachable. See :func:`near_duplicates`."""
    narrow = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("hash"))
    base = stored(narrow.select("id", "hash", _sketched(size)("text").alias("s")).select("id", "hash", "s.*"), "sketches")
    # Of the texts of an id, if there are several, that with the greatest hash stands for the document.
    several = base.where("id is not null").groupBy("id").agg(F.min("hash").alias("lo"), F.max("hash").alias("hi")).where("lo != hi").select("id", F.col("hi").alias("hash"))
    several = stored(several, "several")
    # No hint: the table of such ids, mostly empty, is on disk with its size, by which the join picks its strategy.
    best = stored(base.select("id", "hash", F.col("key").alias("best"), F.col("n").alias("best_n")).join(several, ["id", "hash"]).dropDuplicates(["id"]), "best")
    chosen = best.select("id", F.col("hash").alias("chosen"))
    only = lambda rows: rows.join(chosen, "id", "left").where(F.col("chosen").isNull() | (F.col("chosen") == F.col("hash"))).drop("chosen")
    narrow = only(narrow).drop("hash")
    classes = stored(
        only(base.where("n > 0 and id is not null")).groupBy("key").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.count("*").alias("copies")),
        "classes",
    )
    bands = F.pandas_udf(_band_hashes, T.ArrayType(T.LongType()))
    members = classes.select("rep", F.posexplode(bands("sketch")).alias("place", "band"))
    buckets = stored(members.groupBy("band").agg(F.min("rep").alias("lead"), F.max("rep").alias("last")).where("lead != last").select("band", "lead"), "buckets")
    shared = stored(members.hint("merge").join(buckets.hint("merge"), "band").select("band", "place", "lead", "rep"), "members")
    first = stored(shared.where("lead != rep").select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct(), "pairs")
    links = _verified(_likely(first, classes, percent), narrow, size, percent)
    labels = components(links)

    node = F.coalesce("label", "rep")
    labelled = stored(shared.join(labels.hint("merge"), shared["rep"] == labels["node"], "left").select("band", "place", "rep", node.alias("label")), "labelled")
    sizes = labelled.groupBy("band", "label").count()
    mixed = sizes.groupBy("band").agg(F.max_by("label", F.struct("count", "label")).alias("main"), F.count("*").alias("labels"), F.sum("count").alias("k"))
    mixed = stored(mixed.where("labels > 1").select("band", "main", "k"), "mixed")
    open_ = stored(labelled.join(mixed.hint("merge"), "band").select("band", "place", "k", "rep", "label", (F.col("label") != F.col("main")).alias("few")), "open")
    needed = stored(open_.select(F.col("rep").alias("id")).distinct(), "needed")
    sets = stored(narrow.join(needed.hint("merge"), "id").select(F.col("id").alias("rep"), _short_hashes(size)("text").alias("hashes")).dropDuplicates(["rep"]), "sets")
    full = open_.join(classes.select("rep", "n", "sketch").hint("merge"), "rep").join(sets.hint("merge"), "rep")
    more = _verified(_crossings(full, percent), narrow, size, percent)
    if not more.isEmpty():
        links = links.unionByName(more)
        labels = components(links)
    # Only classes with several documents or with links differ from their own id.
    named = classes.join(labels, classes["rep"] == labels["node"], "left").where("copies > 1 or node is not null").select("key", node.alias("component"))
    named = stored(named, "named")
    rows = base.select("id", "key", "n").join(best.drop("hash"), "id", "left").select("id", F.coalesce("best", "key").alias("key"), F.coalesce("best_n", "n").alias("n"))
    return rows.join(named, "key", "left").select("id", "n", F.coalesce("component", "id").alias("component"))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = 5, percent: int = 80) -> DataFrame:
    """All rows and columns, with ``n_shingles``, ``component_id`` (smallest id reachable) and ``kept`` (that id itself).

    Texts without words have no shingles and are linked with nothing; texts with fewer words than a shingle are
    linked with equal ones only. Rows that share an id are one document (if their texts differ, that with the greatest
    hash counts) and get equal answers. Rows with a null id have a null component and are kept. Ties are broken by id
    alone. Columns named like outputs are replaced, all others stay, whatever their names. An empty table gives an
    empty table. Texts are used whole, whatever their length.
    """
    table = Columns(docs)
    doc_id = table.name(doc_id)
    rows = near_duplicate_rows(table.rows, table.name(text), doc_id, size, percent)
    by_id = rows.where("id is not null").groupBy("id").agg(F.max("n").alias("n_shingles"), F.min("component").alias("component_id"))
    out = table.rows.join(by_id.hint("merge"), table.rows[doc_id] == by_id["id"], "left")
    return table.done(out, {"n_shingles": F.coalesce("n_shingles", F.lit(0)), "component_id": "component_id", "kept": _kept(F.col(doc_id))})


def _kept(doc_id: Column) -> Column:
    return F.coalesce(doc_id == F.col("component_id"), F.lit(True))


def op6_near_duplicates(docs: DataFrame) -> DataFrame:
    """Contract of the query: shingles of four words, a similarity of 0.8 or more."""
    rows = near_duplicate_rows(docs, size=4)
    return rows.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id")).withColumn("kept", _kept(F.col("doc_id")))

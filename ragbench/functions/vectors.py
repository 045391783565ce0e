"""Vector arithmetic in column expressions, and a default embedding that needs no model."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragbench.functions.text import words

DIM = 64


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if a norm is 0."""
    size = norm(a) * norm(b)
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)


def _places(words: list[str], dim: int, kept: dict[str, int]) -> np.ndarray:
    out = np.zeros(2 * dim)
    for w in words:
        if w not in kept:
            kept[w] = int(hashlib.md5(w.encode()).hexdigest()[:7], 16) % (2 * dim)
        out[kept[w]] += 1
    return out[:dim] - out[dim:]


def hash_embedding(text: Column, dim: int = DIM) -> Column:
    """Signed feature hashing of the text's words: md5 sends a word to one of ``dim`` places and gives its sign."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        kept: dict[str, int] = {}
        for tokens in batches:
            if len(kept) > 500_000:
                kept.clear()
            yield pd.Series([None if t is None else _places(list(t), dim, kept) for t in tokens])

    return F.pandas_udf(run, T.ArrayType(T.DoubleType()))(words(text))


def embed_distinct(rows: DataFrame, text: str, known: DataFrame | None = None, embed=hash_embedding) -> DataFrame:
    """(text, vector) for each distinct text: known vectors are reused, only the others are computed."""
    distinct = rows.select(F.col(text).alias("text")).where("text is not null").distinct()
    if known is None:
        return distinct.withColumn("vector", embed(F.col("text")))
    new = distinct.hint("merge").join(known.select("text"), "text", "left_anti").withColumn("vector", embed(F.col("text")))
    return distinct.hint("merge").join(known.select("text", "vector"), "text").unionByName(new)


#: What models were trained to see before a document and before a query.
PREFIXES = {"e5": ("passage: ", "query: "), "embeddinggemma": ("title: none | text: ", "task: search result | query: ")}


def prefixed(text: Column, model: str, query: bool = False) -> Column:
    """The text as a model expects it; models without a prefix see it as it is."""
    return F.concat(F.lit(PREFIXES.get(model, ("", ""))[query]), text)


def question_vectors(questions: DataFrame, embedders: dict) -> DataFrame:
    """(embedding, text, vector): every distinct question once for each embedding (a dict of name to column function), ahead of any retrieval."""
    texts = questions.select("text").where("text is not null").distinct()
    parts = [texts.select(F.lit(name).alias("embedding"), "text", embed(prefixed(F.col("text"), name, query=True)).alias("vector")) for name, embed in embedders.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out

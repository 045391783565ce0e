"""Nearest chunks for many questions at once. Results are (qid, rank, chunk_id, score); ranks begin at 1."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ragbench.functions.vectors import cosine
from ragbench.sources.shared import written

#: Questions that are broadcast at once (more are taken in turns), and questions whose scores are held at once.
BLOCK, SCORED = 20_000, 256


def _unit(rows: list) -> np.ndarray:
    m = np.array([np.asarray(r, dtype=np.float64) for r in rows])
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def _best(row: np.ndarray, key: np.ndarray, held: tuple | None, k: int) -> tuple:
    """(scores, keys) of the k best of a row and those held so far, by falling score, then key."""
    if held is not None and len(held[0]) == k:
        near = np.flatnonzero(row >= held[0][-1])
        if not len(near):
            return held
        row, key = row[near], key[near]
    if len(row) > k:
        near = np.flatnonzero(row >= np.partition(row, -k)[-k])
        row, key = row[near], key[near]
    if held is not None:
        row, key = np.concatenate([held[0], row]), np.concatenate([held[1], key])
    order = np.lexsort((key, -row))[:k]
    return row[order], key[order]


def top_k(questions: DataFrame, chunks: DataFrame, k: int, qid: str = "qid", vector: str = "vector", where: str | None = None) -> DataFrame:
    """Exact top-k by cosine (rounded to 9 digits; ties by chunk_id): each partition of chunks sends at most k rows a question.

    ``chunks`` has chunk_id and the vector; ``where`` is a filter on its columns, pushed down to the scan. At most
    BLOCK questions are held on the driver and broadcast at a time, so their number is not bounded by memory.
    """
    spark = questions.sparkSession
    rows = (chunks.where(where) if where else chunks).select("chunk_id", F.col(vector).alias("vector")).where("vector is not null")
    turns = max(1, -(-questions.count() // BLOCK))
    found = None
    q_type = questions.schema[qid].dataType.simpleString()
    schema = f"qid {q_type}, chunk_id {rows.schema['chunk_id'].dataType.simpleString()}, score double"
    for turn in range(turns):
        part = questions.where(F.pmod(F.xxhash64(qid), F.lit(turns)) == turn) if turns > 1 else questions
        held = part.select(qid, vector).where(F.col(vector).isNotNull()).collect()
        shared = spark.sparkContext.broadcast(([r[0] for r in held], _unit([r[1] for r in held]) if held else None))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, q = shared.value
            best: list[tuple | None] = [None] * len(ids)
            for batch in batches:
                if not ids or not len(batch):
                    continue
                key, vectors = batch["chunk_id"].to_numpy(), _unit(list(batch["vector"])).T
                for at in range(0, len(ids), SCORED):
                    scores = np.round(q[at : at + SCORED] @ vectors, 9)
                    for i, row in enumerate(scores, at):
                        best[i] = _best(row, key, best[i], k)
            held = [i for i, b in enumerate(best) if b is not None]
            for at in range(0, len(held), 5000):
                some = held[at : at + 5000]
                yield pd.DataFrame({"qid": [ids[i] for i in some for _ in best[i][0]], "chunk_id": np.concatenate([best[i][1] for i in some]), "score": np.concatenate([best[i][0] for i in some])})

        one = rows.mapInPandas(run, schema)
        found = one if found is None else found.unionByName(one)
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "chunk_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("qid", "rank", "chunk_id", "score")


#: Vectors that codebooks are fitted on, numbers of a vector that share a code, and codes for them (one byte).
SAMPLE, CODED, CODES = 8_192, 4, 256


def fit_codebooks(vectors: np.ndarray, seed: int, rounds: int = 10) -> np.ndarray:
    """(part, code, number): k-means of every stretch of CODED numbers of unit vectors; a centre that loses all vectors stays where it was."""
    rng = np.random.default_rng(seed)
    parts = vectors.reshape(len(vectors), -1, CODED).transpose(1, 0, 2)
    books = parts[:, rng.choice(len(vectors), size=min(CODES, len(vectors)), replace=False)].copy()
    for part, book in zip(parts, books, strict=True):
        for _ in range(rounds):
            near = _codes(part, book)
            count = np.bincount(near, minlength=len(book))
            sums = np.stack([np.bincount(near, part[:, j], len(book)) for j in range(CODED)], axis=1)
            book[count > 0] = sums[count > 0] / count[count > 0, None]
    return books


def _codes(part: np.ndarray, book: np.ndarray) -> np.ndarray:
    """The nearest centre of each row."""
    return (part @ book.T - (book * book).sum(1) / 2).argmax(1)


def _padded(vectors: np.ndarray) -> np.ndarray:
    return np.pad(vectors, ((0, 0), (0, -vectors.shape[1] % CODED)))


def vector_index(chunks: DataFrame, sample: int = SAMPLE, seed: int = 5) -> tuple[DataFrame, np.ndarray | None]:
    """(chunk_id, code) of every chunk with a vector, written, and the codebooks: one byte for CODED numbers, a sixteenth of 32-bit vectors.

    Codebooks are fitted on at most ``sample`` vectors, chosen by a hash of the id; each row is coded.
    """
    spark = chunks.sparkSession
    rows = chunks.select("chunk_id", "vector").where("vector is not null")
    held = rows.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(sample).select("vector").collect()
    if not held:
        return rows.select("chunk_id", F.lit(None).cast("binary").alias("code")), None
    books = fit_codebooks(_padded(_unit([r[0] for r in held])), seed)
    shared = spark.sparkContext.broadcast(books)

    def code(vectors: pd.Series) -> pd.Series:
        parts = _padded(_unit(list(vectors))).reshape(len(vectors), -1, CODED)
        coded = np.stack([_codes(parts[:, j], book) for j, book in enumerate(shared.value)], axis=1).astype(np.uint8)
        return pd.Series([x.tobytes() for x in coded])

    return written(rows.select("chunk_id", F.pandas_udf(code, "binary")("vector").alias("code")), "codes"), books


def score_tables(asked: np.ndarray, books: np.ndarray) -> np.ndarray:
    """(part, question, code): scores of questions (question, part, number) with all centres."""
    return np.einsum("qpd,pcd->pqc", asked, books).astype(np.float32)


def approximate_top_k(questions: DataFrame, chunks: DataFrame, k: int, ranked: int | None = None, index: tuple[DataFrame, np.ndarray | None] | None = None) -> DataFrame:
    """Top-k by exact cosine among the ``ranked`` chunks (ten times k) that product-quantised codes put first.

    A question's scores with all centres are a table for each part of a vector, and a chunk's estimate is the sum of the entries its
    code names, so the scan reads codes, a sixteenth of the vectors; of the vectors themselves ``ranked`` a question are read. Each
    partition of codes sends ``ranked`` rows a question at most. ``index`` is one of :func:`vector_index`, which is made if it isn't given. Chunks that are fewer
    than ``ranked`` are all ranked exactly.
    """
    spark, ranked = questions.sparkSession, ranked or 10 * k
    codes, books = index or vector_index(chunks)
    q_type, id_type = questions.schema["qid"].dataType.simpleString(), chunks.schema["chunk_id"].dataType.simpleString()
    turns, found = max(1, -(-questions.count() // BLOCK)), None
    for turn in range(turns):
        part = questions.where(F.pmod(F.xxhash64("qid"), F.lit(turns)) == turn) if turns > 1 else questions
        held = part.select("qid", "vector").where("vector is not null").collect()
        asked = _padded(_unit([r[1] for r in held])).reshape(len(held), -1, CODED) if held and books is not None else None
        shared = spark.sparkContext.broadcast(([r[0] for r in held], asked, books))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, asked, books = shared.value
            best: list[tuple | None] = [None] * len(ids)
            for batch in batches:
                if asked is None or not len(batch):
                    continue
                key, code = batch["chunk_id"].to_numpy(), np.frombuffer(b"".join(batch["code"]), dtype=np.uint8).reshape(len(batch), -1)
                for at in range(0, len(ids), SCORED):
                    # Tables are made for a few questions at a time, as those of a whole block take hundreds of MB in each worker.
                    tables = score_tables(asked[at : at + SCORED], books)
                    scores = sum(t[:, c] for t, c in zip(tables, code.T, strict=True))
                    for i, row in enumerate(scores, at):
                        best[i] = _best(row, key, best[i], ranked)
            for i, b in enumerate(best):
                if b is not None:
                    yield pd.DataFrame({"qid": ids[i], "chunk_id": b[1], "estimate": b[0].astype(float)})

        one = codes.mapInPandas(run, f"qid {q_type}, chunk_id {id_type}, estimate double")
        found = one if found is None else found.unionByName(one)
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("estimate"), "chunk_id"))
    first = written(found.withColumn("n", rank).where(F.col("n") <= ranked).select("qid", "chunk_id"), "ranked")
    asked = questions.select("qid", F.col("vector").alias("qv")).where("qv is not null")
    scored = first.join(asked, "qid").join(chunks.select("chunk_id", "vector"), "chunk_id").select("qid", "chunk_id", F.round(cosine(F.col("qv"), F.col("vector")), 9).alias("score"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "chunk_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("qid", "rank", "chunk_id", "score")


def similarity(questions: DataFrame, chunks: DataFrame, k: int = 5) -> DataFrame:
    return top_k(questions, chunks, k)


def _select_diverse(scores: np.ndarray, vectors: np.ndarray, k: int, weight: float) -> list[int]:
    chosen: list[int] = []
    nearest = np.zeros(len(scores))
    left = list(range(len(scores)))
    sims = vectors @ vectors.T
    while left and len(chosen) < k:
        value = [weight * scores[i] - (1 - weight) * (nearest[i] if chosen else 0.0) for i in left]
        best = left[int(np.argmax(np.round(value, 12)))]
        left.remove(best)
        nearest = sims[best] if not chosen else np.maximum(nearest, sims[best])
        chosen.append(best)
    return chosen


def mmr(questions: DataFrame, chunks: DataFrame, k: int = 5, fetch: int = 20, weight: float = 0.5) -> DataFrame:
    """Of the ``fetch`` nearest, k that maximise weight * relevance - (1 - weight) * similarity to those chosen; ranks in that order."""
    near = top_k(questions, chunks, fetch).join(chunks.select("chunk_id", "vector").hint("merge"), "chunk_id")
    q_type, c_type = questions.schema["qid"].dataType.simpleString(), chunks.schema["chunk_id"].dataType.simpleString()

    def pick(group: pd.DataFrame) -> pd.DataFrame:  # at most ``fetch`` rows
        group = group.sort_values("rank").reset_index(drop=True)
        chosen = _select_diverse(group["score"].to_numpy(), _unit(list(group["vector"])), k, weight)
        out = group.loc[chosen, ["qid", "chunk_id", "score"]]
        return out.assign(rank=range(1, len(out) + 1))[["qid", "rank", "chunk_id", "score"]]

    return near.groupBy("qid").applyInPandas(pick, f"qid {q_type}, rank int, chunk_id {c_type}, score double")


def multi_query(variants: DataFrame, chunks: DataFrame, k: int = 5) -> DataFrame:
    """``variants`` has qid, variant (0 is the question) and vector. The union of their results; of a chunk found twice the first stays."""
    keyed = variants.withColumn("key", F.struct("qid", "variant"))
    found = top_k(keyed.select(F.to_json("key").alias("qid"), "vector"), chunks, k)
    found = found.withColumn("key", F.from_json("qid", keyed.schema["key"].dataType)).select("key.qid", "key.variant", "rank", "chunk_id", "score")
    first = F.row_number().over(Window.partitionBy("qid", "chunk_id").orderBy("variant", "rank"))
    kept = found.withColumn("n", first).where("n = 1")
    return kept.select("qid", F.row_number().over(Window.partitionBy("qid").orderBy("variant", "rank")).alias("rank"), "chunk_id", "score")


def parent_document(hits: DataFrame, chunks: DataFrame, window: int = 1) -> DataFrame:
    """Hits (qid, rank, doc, chunk_index, score) with the text of the chunks up to ``window`` away in the same document."""
    around = hits.withColumn("near", F.explode(F.sequence(F.col("chunk_index") - window, F.col("chunk_index") + window)))
    texts = chunks.select("doc", F.col("chunk_index").alias("near"), "text")
    joined = around.hint("merge").join(texts, ["doc", "near"])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("near", "text"))), lambda x: x["text"]), " ")
    return joined.groupBy("qid", "rank", "doc", "chunk_index", "score").agg(text.alias("text"))


#: Words of the run that stands for a passage, and the most runs broadcast at a time.
ANCHOR, MOST_ANCHORS = 5, 500_000


def shared_shingles(left: DataFrame, right: DataFrame, size: int = 8) -> DataFrame:
    """Blocking for fuzzy text joins: (left_id, right_id, shared) for texts that share runs of ``size`` words, with the number of distinct ones.

    Both sides have id and text. A text on the left with fewer words is one run of its own length, sought among the
    right's runs of that length. Runs are joined by a hash of 128 bits, and the right's runs, most of which the left
    lacks, take no part in any shuffle but that of a join with very many runs of the left: repeats are dropped after it.
    """
    from ragbench.functions.text import normal_words

    def split(rows: DataFrame, name: str) -> DataFrame:
        # The words are a column before the explode, so that they are split once for a text and not for each run.
        return rows.where("text is not null").select(F.col("id").alias(name), F.split(normal_words(F.col("text")), " ").alias("t"))

    def runs(t: DataFrame, name: str) -> DataFrame:
        at = t.where(F.size("t") >= F.col("n")).select(name, "t", "n", F.explode(F.sequence(F.lit(1), F.size("t") - F.col("n") + 1)).alias("i"))
        run = F.slice("t", F.col("i"), F.col("n"))
        return at.select(name, F.xxhash64(run).alias("h"), F.xxhash64(F.lit(1), run).alias("h2"))

    sought = split(left, "left_id").withColumn("n", F.least(F.size("t"), F.lit(size)))
    lengths = sorted(r[0] for r in sought.select("n").distinct().collect())  # at most ``size`` rows
    held = split(right, "right_id").withColumn("n", F.explode(F.array(*map(F.lit, lengths or [size]))))
    mine = runs(sought, "left_id")
    # Few enough are broadcast, so that the right's runs aren't shuffled at all.
    how = "broadcast" if mine.count() <= MOST_ANCHORS else "merge"
    met = runs(held, "right_id").join(mine.distinct().hint(how), ["h", "h2"])
    return met.distinct().groupBy("left_id", "right_id").agg(F.count("*").alias("shared"))


def holding(passages: DataFrame, texts: DataFrame) -> DataFrame:
    """(passage_id, the columns of ``texts`` but for text): texts that hold a passage (id, text) word for word, each row of texts once.

    Case and repeated white space don't count. Only a passage's first and last word can be cut out of longer ones, so the
    run of inner words with most characters stands whole in every text that holds it. Each text looks up its runs among
    those, which are broadcast, and containment is decided where the text is: texts are never shuffled. Passages without
    inner words are sought in every text.
    """
    from ragbench.functions.text import name_key

    columns = [c for c in texts.columns if c != "text"]
    sought = passages.where("text is not null").select(F.col("id").alias("passage_id"), name_key(F.col("text")).alias("passage"))
    words = lambda key: F.split(F.btrim(F.regexp_replace(key, r"[^\p{L}\p{N}]+", " ")), " ")
    all_words = words(F.col("passage"))
    sought = sought.withColumn("w", F.slice(all_words, 2, F.greatest(F.size(all_words) - 2, F.lit(0)))).withColumn("n", F.least(F.size("w"), F.lit(ANCHOR)))
    run = F.transform(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1), lambda i: F.slice("w", i, F.col("n")))
    sized = F.transform(run, lambda r: F.struct(F.length(F.array_join(r, "")).alias("chars"), r.alias("run")))
    sought = sought.withColumn("h", F.when(F.col("n") > 0, F.xxhash64(F.array_max(sized)["run"]))).drop("w")
    sizes = {r["n"]: r["count"] for r in sought.groupBy("n").count().collect()}  # at most ANCHOR + 1 rows
    # The row's number tells equal rows of texts apart. As it stands beside the words, no filter on them is worked out below it once more.
    rows = texts.where("text is not null").select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(columns)), name_key(F.col("text")).alias("key"))
    rows = rows.select("*", words(F.col("key")).alias("t"), F.monotonically_increasing_id().alias("row"))
    kept = [F.col(f"c{i}").alias(c) for i, c in enumerate(columns)]
    found = sought.where("false").join(rows.drop("t").where("false"), F.lit(True))
    for n, count in sorted(sizes.items()):
        blocks = -(-count // MOST_ANCHORS)
        for block in range(blocks):
            few = F.broadcast(sought.where((F.col("n") == n) & (F.pmod(F.xxhash64(F.lit(2), "passage_id"), F.lit(blocks)) == block)))
            if n:
                runs = rows.where(F.size("t") >= n).select("*", F.explode(F.sequence(F.lit(1), F.size("t") - n + 1)).alias("i"))
                met = runs.withColumn("at", F.xxhash64(F.slice("t", F.col("i"), n))).join(few, F.col("at") == F.col("h")).drop("t", "i", "at")
            else:
                met = rows.drop("t").join(few, F.contains("key", "passage"))
            found = found.unionByName(met)
    held = found.where(F.contains("key", "passage")).dropDuplicates(["passage_id", "row"])
    return held.select("passage_id", *kept)

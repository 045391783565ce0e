"""Difficulty of questions: signals, observed difficulty, rank correlations and a Rasch fit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragbench.functions.text import fold, normal_words, pt_tokens
from ragbench.functions.vectors import cosine
from ragbench.operators.ordered import in_ranges, running_sums
from ragbench.sources.shared import written

#: Portuguese patterns of question signals, on lower-case text.
PATTERNS = {
    "temporal": r"\b(quando|hor[aá]rios?|que horas|datas?|[eé]poca|abre|fecha|funcionamento)\b",
    "numeric": r"\b(quant[oa]s?|pre[cç]os?|custa|custo|valor|dist[aâ]ncia|km|quil[oô]metros?)\b",
    "negation": r"\b(n[aã]o|nunca|nenhum|nenhuma|sem)\b",
    "aggregation": r"\b(quais|principais|liste|todos|todas|op[cç][oõ]es)\b",
    "yes_no": r"^\W*(tem|h[aá]|[eé]|d[aá]|pode|posso|existe|vale)\b",
}


def question_signals(text: Column) -> list[Column]:
    low = F.lower(text)
    flags = [F.coalesce(low.rlike("(?U)" + p).cast("double"), F.lit(0.0)).alias(n) for n, p in PATTERNS.items()]
    marks = F.greatest(F.lit(1), F.regexp_count(text, F.lit(r"\?")))
    return [F.size(pt_tokens(text)).cast("double").alias("question_length"), marks.cast("double").alias("sub_questions"), *flags]


def document_frequency(texts: DataFrame, text: str = "text") -> DataFrame:
    """(token, df) over texts."""
    return texts.where(F.col(text).isNotNull()).select(F.explode(F.array_distinct(pt_tokens(F.col(text)))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))


def corpus_signals(questions: DataFrame, df: DataFrame, n_docs: int) -> DataFrame:
    """mean_idf, max_idf and out_of_corpus by question (qid, text); idf = ln((N+1)/(df+1)), tokens counted as often as they occur."""
    tokens = questions.select("qid", F.explode(pt_tokens(F.col("text"))).alias("token")).join(df.hint("merge"), "token", "left")
    idf = F.log((F.lit(n_docs) + 1) / (F.coalesce("df", F.lit(0)) + 1))
    found = tokens.groupBy("qid").agg(F.avg(idf).alias("mean_idf"), F.max(idf).alias("max_idf"), F.avg(F.col("df").isNull().cast("double")).alias("out_of_corpus"))
    return questions.select("qid").join(found.hint("merge"), "qid", "left").fillna(0.0, ["mean_idf", "max_idf", "out_of_corpus"])


def evidence_signals(evidence: DataFrame) -> DataFrame:
    """evidence_count and evidence_overlap; evidence has qid, question and passages (array)."""
    t = evidence.select("qid", F.size("passages").cast("double").alias("evidence_count"), pt_tokens(F.col("question")).alias("q"), pt_tokens(F.array_join("passages", " ")).alias("e"))
    tokens = t.select("qid", F.explode("q").alias("token"), "e").groupBy("qid").agg(F.avg(F.array_contains("e", F.col("token")).cast("double")).alias("evidence_overlap"))
    return t.select("qid", "evidence_count").join(tokens.hint("merge"), "qid", "left").fillna(0.0, ["evidence_overlap"])


def retrieval_signals(hits: DataFrame) -> DataFrame:
    """top_score, score_gap (0 with one score) and score_spread (population) by question.

    No row without scores, nor where every context is a compression's, whose score is not a retrieval's.
    """
    if "source" in hits.columns:
        retrieved = hits.where("source is null or source <> 'compression'").select("qid").distinct()
        hits = hits.join(retrieved.hint("merge"), "qid", "left_semi")
    s = hits.where("score is not null").groupBy("qid").agg(F.sort_array(F.collect_list("score"), False).alias("s"), F.stddev_pop("score").alias("score_spread"))
    return s.select("qid", F.col("s")[0].alias("top_score"), F.when(F.size("s") > 1, F.get("s", F.lit(0)) - F.get("s", F.lit(1))).otherwise(0.0).alias("score_gap"), "score_spread")


def evidence_distance(pairs: DataFrame) -> DataFrame:
    """1 - least cosine of a question and its passages; pairs have qid, question_vector, passage_vector."""
    return pairs.groupBy("qid").agg((1 - F.min(cosine(F.col("question_vector"), F.col("passage_vector")))).alias("evidence_distance"))


#: The most questions and passages that meet in one task.
QUESTIONS, PASSAGES = 2_000, 50_000


def evidence_distance_within(questions: DataFrame, passages: DataFrame) -> DataFrame:
    """``evidence_distance`` of questions (qid, label, vector) to all passages (id, label, vector) of their label.

    Blocks of a label's questions meet blocks of its passages by matrix products, so no pair is a row.
    """
    questions, passages = (t.where("label is not null and vector is not null") for t in (questions, passages))
    most = [t.groupBy("label").count().agg(F.max("count")).first()[0] or 1 for t in (questions, passages)]
    parts = [-(-n // size) for n, size in zip(most, (QUESTIONS, PASSAGES))]
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = questions.select("qid", "label", "vector", block("qid", parts[0]).alias("a"), every(parts[1]).alias("b"))
    held = passages.select(F.col("label").alias("of"), F.col("vector").alias("passage"), every(parts[0]).alias("c"), block("id", parts[1]).alias("d"))

    def unit(vectors: pd.Series) -> np.ndarray:
        rows = np.array(vectors.tolist(), dtype=np.float64)
        size = np.sqrt((rows * rows).sum(1, keepdims=True))
        return np.divide(rows, size, out=np.zeros_like(rows), where=size > 0)

    def run(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        if not len(one) or not len(two):
            return pd.DataFrame({"qid": one["qid"][:0], "least": np.zeros(0)})
        a, b = unit(one["vector"]), unit(two["passage"])
        least = np.min([(a @ b[k : k + 4096].T).min(1) for k in range(0, len(b), 4096)], axis=0)
        return pd.DataFrame({"qid": one["qid"], "least": least})

    schema = T.StructType([T.StructField("qid", questions.schema["qid"].dataType), T.StructField("least", T.DoubleType())])
    found = asked.groupBy("label", "a", "b").cogroup(held.groupBy("of", "c", "d")).applyInPandas(run, schema)
    return found.groupBy("qid").agg((1 - F.min("least")).alias("evidence_distance"))


def perplexity(logprobs: DataFrame) -> DataFrame:
    """exp of minus the mean log-probability by (model, qid); NaN does not count."""
    return logprobs.where("not isnan(logprob)").groupBy("model", "qid").agg(F.exp(-F.avg("logprob")).alias("perplexity"))


def observed_difficulty(scores: DataFrame) -> DataFrame:
    """By (question, llm, kind, metric): mean, population deviation, n; kind is the technique's, others count as retrieval."""
    kind = F.when(F.col("rag").isin("closed_book", "oracle"), F.col("rag")).otherwise("retrieval")
    ok = scores.where(~F.col("answer").startswith("[ERRO: ")).withColumn("kind", kind)
    return ok.groupBy("question", "llm", "kind", "metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count("*").alias("n"))


def by_hit(results: DataFrame, metric: str) -> DataFrame:
    """By question: hit rate, and the metric's mean with and without evidence in the context."""
    ok = results.where(~F.col("answer").startswith("[ERRO: "))
    return ok.groupBy("question").agg(
        F.avg("context_hit").alias("hit_rate"), F.avg(F.when(F.col("context_hit") == 1, F.col(metric))).alias("with_evidence"), F.avg(F.when(F.col("context_hit") == 0, F.col(metric))).alias("without_evidence")
    )


def mid_ranks(counts: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """(by, value, name): the mean rank of each value in its series, from counted values (by, value, n).

    Places are running sums of counts over the order of all series (``ordered``), so a series may fill any number of ranges.
    """
    counts = counts.groupBy(*by, value).agg(F.sum("n").alias("n"))
    order = [*by, value]
    placed = running_sums(in_ranges(counts, order, "mid-ranks"), order, {"upto": F.col("n")}, by)
    return placed.select(*order, (F.col("upto") - (F.col("n") - 1) / 2).alias(name))


def spearman(rows: DataFrame, by: list[str], x: str, y: str, least: int = 3) -> DataFrame:
    """Correlation of mid-ranks by series; null under ``least`` pairs or when a side does not vary.

    Equal pairs are counted first; a series' mean mid-rank is (n + 1) / 2.
    """
    names = [f"by{k}" for k in range(len(by))]
    pairs = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*(F.col(c).alias(n) for c, n in zip(by, names, strict=True)), F.col(x).alias("x"), F.col(y).alias("y"))
    counts = written(pairs.groupBy(*names, "x", "y").agg(F.count(F.lit(1)).alias("n")), "pairs")
    sizes = counts.groupBy(*names).agg(F.sum("n").alias("size"))
    out = counts
    for value in ("x", "y"):
        ranks = written(mid_ranks(counts, names, value, f"rank_{value}"), "ranks").toDF(*(f"{n}_of" for n in names), f"{value}_of", f"rank_{value}")
        same = F.col(value) == F.col(f"{value}_of")
        for n in names:
            same = same & F.col(n).eqNullSafe(F.col(f"{n}_of"))
        out = out.join(ranks, same).drop(*(f"{n}_of" for n in names))
    same = F.lit(True)
    sizes = written(sizes, "sizes").toDF(*(f"{n}_of" for n in names), "size")
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"{n}_of"))
    dx, dy = (F.col(f"rank_{v}") - (F.col("size") + 1) / 2 for v in ("x", "y"))
    total = lambda v: F.sum(F.col("n") * v)
    sums = out.join(sizes, same).groupBy(*names).agg(F.sum("n").alias("n"), total(dx * dy).alias("xy"), total(dx * dx).alias("xx"), total(dy * dy).alias("yy"))
    usable = (F.col("n") >= least) & (F.col("xx") > 0) & (F.col("yy") > 0)
    return sums.select(*(F.col(n).alias(c) for c, n in zip(by, names, strict=True)), "n", F.when(usable, F.col("xy") / F.sqrt(F.col("xx") * F.col("yy"))).alias("rho"))


def signal_correlations(signals: DataFrame, difficulty: DataFrame, names: list[str]) -> DataFrame:
    """Spearman of each signal (wide, by question) with difficulty (question, scope, difficulty)."""
    long = signals.select("question", F.explode(F.array(*(F.struct(F.lit(n).alias("signal"), F.col(n).cast("double").alias("value")) for n in names))).alias("s")).select("question", "s.*")
    return spearman(long.hint("merge").join(difficulty, "question"), ["signal", "scope"], "value", "difficulty")


def lexical_echo(rows: DataFrame, stop: list[str]) -> DataFrame:
    """Share of a question's content words (longer than a letter, not stop words) that its evidence holds; rows have qid, question, evidence."""
    def content(text: Column) -> Column:
        return F.array_distinct(F.filter(F.split(normal_words(fold(text)), " "), lambda w: (F.length(w) > 1) & ~w.isin(*stop)))

    q = content(F.col("question"))
    return rows.select("qid", F.when(F.size(q) > 0, F.size(F.array_intersect(q, content(F.col("evidence")))) / F.size(q)).alias("echo"))


def rasch_cells(responses: DataFrame) -> DataFrame:
    """(scope, person, question, y): responses (scope, config, llm, question, result_id, value): the last row of a cell's configuration wins, then configurations are averaged by cell; y is held within 0 and 1."""
    last = responses.groupBy("question", "scope", "config", "llm").agg(F.max_by("value", F.struct("result_id", "value")).alias("value"))
    y = F.least(F.greatest(F.col("value"), F.lit(0.0)), F.lit(1.0))
    return last.select("scope", F.concat_ws("/", "config", "llm").alias("person"), "question", y.alias("y"))


def fit_cells(person: np.ndarray, item: np.ndarray, y: np.ndarray, l2: float = 0.1, steps: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """The plain form of ``rasch`` for one scope. Abilities and difficulties: alternating diagonal Newton steps of 1 at most, with an L2 penalty; difficulties are centred."""
    theta, b = np.zeros(person.max() + 1), np.zeros(item.max() + 1)
    for _ in range(steps):
        moved = 0.0
        for sign, at, values in ((1.0, person, theta), (-1.0, item, b)):
            p = 1 / (1 + np.exp(-(theta[person] - b[item])))
            slope = sign * np.bincount(at, y - p, len(values)) - l2 * values
            step = np.clip(slope / (np.bincount(at, p * (1 - p), len(values)) + l2), -1, 1)
            values += step
            moved = max(moved, abs(step).max())
        shift = b.mean()
        b -= shift
        theta -= shift
        if moved < 1e-10:
            break
    return theta, b


def rasch(cells: DataFrame, least: int = 3, reliable: int = 50, l2: float = 0.1, steps: int = 200, tolerance: float = 1e-9) -> DataFrame:
    """(scope, question, difficulty, reliable): one fit for each scope with ``least`` questions, all scopes at once.

    The same alternating steps as ``fit_cells``. Only the sum of a question's answers counts, so its cells are packed once into one
    row: its people's numbers, that sum and its difficulty. A step reads these rows with all abilities (one number for each person,
    that is configuration and model), which come from the driver, and shuffles nothing but each task's sums by person. Abilities and
    difficulties move together when difficulties are centred, so only the penalty needs the centre. It ends when no centred
    difficulty moves by ``tolerance`` any more (some six steps), which is looked at every third step, or after ``steps``.
    """
    cell = F.when(F.col("person").isNotNull() & F.col("y").isNotNull(), F.struct("person", "y"))
    rows = written(cells.where("scope is not null").groupBy("question", "scope").agg(F.collect_list(cell).alias("cells"), F.sum("y").alias("sum")), "cells")
    sizes = written(rows.groupBy("scope").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least), "scopes")
    rows = rows.where("question is not null and size(cells) > 0").join(F.broadcast(sizes.select("scope")), "scope").select("scope", "question", "cells", "sum")  # one row for each scope
    held = rows.select("scope", F.explode("cells").alias("c")).groupBy("scope", "c.person").agg(F.sum("c.y").alias("sum")).toPandas().sort_values(["scope", "person"])
    scopes, people = sorted(set(held["scope"])), sorted(set(held["person"]))
    of = held["scope"].map({s: k for k, s in enumerate(scopes)}).to_numpy(dtype=np.int64)
    known = of * len(people) + held["person"].map({x: k for k, x in enumerate(people)}).to_numpy(dtype=np.int64)
    sums, t, centre = held["sum"].to_numpy(dtype=np.float64), np.zeros(len(held)), np.zeros(len(scopes))
    names = rows.sparkSession.sparkContext.broadcast((scopes, people, known))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scopes, people, known = names.value
        for batch in batches:
            lists = batch.column("cells")
            size = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            at = pc.index_in(batch.column("scope"), value_set=pa.array(scopes, batch.column("scope").type)).to_numpy(zero_copy_only=False).astype(np.int64)
            who = lists.flatten().field("person")
            who = np.repeat(at, size) * len(people) + pc.index_in(who, value_set=pa.array(people, who.type)).to_numpy(zero_copy_only=False)
            numbers = pa.ListArray.from_arrays(pa.array(np.append(0, size.cumsum()), pa.int32()), pa.array(np.searchsorted(known, who), pa.int32()))
            nought = pa.array(np.zeros(len(at)))
            yield pa.RecordBatch.from_arrays([batch.column("scope"), batch.column("question"), pa.array(at), numbers, batch.column("sum"), nought, nought], ["scope", "question", "at", "people", "sum", "b", "old"])

    schema = T.StructType(list(rows.select("scope", "question").schema)).add("at", "long").add("people", T.ArrayType(T.IntegerType())).add("sum", "double").add("b", "double").add("old", "double")
    packed = written(rows.mapInArrow(number, schema), "questions")

    def chances(batch: pa.RecordBatch, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each cell its row, its person and the chance of a right answer; and the rows' difficulties."""
        lists = batch.column("people")
        no, b = lists.flatten().to_numpy(zero_copy_only=False), batch.column("b").to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(b)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        return row, no, 1 / (1 + np.exp(b[row] - t[no])), b

    def by_person(rows: DataFrame, t: np.ndarray) -> pd.DataFrame:
        shared = rows.sparkSession.sparkContext.broadcast(t)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((2, len(shared.value)))
            for batch in batches:
                _, no, p, _ = chances(batch, shared.value)
                total += [np.bincount(no, v, total.shape[1]) for v in (p, p * (1 - p))]
            met = np.flatnonzero(total[0])
            yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[0][met]), pa.array(total[1][met])], ["no", "p", "weight"])

        return rows.select("people", "b").mapInArrow(run, "no long, p double, weight double").groupBy("no").agg(F.sum("p").alias("p"), F.sum("weight").alias("weight")).toPandas().sort_values("no")

    def moved(rows: DataFrame, t: np.ndarray, centre: np.ndarray) -> DataFrame:
        shared = rows.sparkSession.sparkContext.broadcast((t, centre))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t, centre = shared.value
            for batch in batches:
                row, _, p, b = chances(batch, t)
                middle = centre[batch.column("at").to_numpy(zero_copy_only=False)]
                slope = np.bincount(row, p, len(b)) - batch.column("sum").to_numpy(zero_copy_only=False) - l2 * (b - middle)
                step = np.clip(slope / (np.bincount(row, p * (1 - p), len(b)) + l2), -1, 1)
                yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(b + step), pa.array(b)], batch.schema.names)

        return written(rows.mapInArrow(run, rows.schema), "questions")

    for k in range(1, steps + 1 if len(held) else 0):
        met = by_person(packed, t)
        t = t + np.clip((sums - met["p"].to_numpy() - l2 * (t - centre[of])) / (met["weight"].to_numpy() + l2), -1, 1)
        packed = moved(packed, t, centre)
        change = F.col("b") - F.col("old")
        seen = packed.groupBy("at").agg(F.avg("b").alias("centre"), F.avg(change).alias("mean"), F.max(change).alias("up"), F.min(change).alias("down")).collect()
        for r in seen:  # one row for each scope
            centre[r["at"]] = r["centre"]
        if k % 3 == 0 and max(max(r["up"] - r["mean"], r["mean"] - r["down"]) for r in seen) < tolerance:
            break
    middle = packed.groupBy("scope").agg(F.avg("b").alias("centre")).join(sizes, "scope")
    return packed.join(F.broadcast(middle), "scope").select("scope", "question", (F.col("b") - F.col("centre")).alias("difficulty"), (F.col("n") >= reliable).alias("reliable"))


def hardest_first(questions: DataFrame) -> DataFrame:
    """Place by falling difficulty: the fitted one, else minus the mean, else last; ties by question."""
    key = F.coalesce("irt", -F.col("mean"), F.lit(-2.0))
    return questions.withColumn("key", key).orderBy(F.desc("key"), "question")

"""Retrieval techniques as batch pipelines. Model replies are tables: a hook fills what is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def context_block(contexts: DataFrame) -> DataFrame:
    """(qid, context): the texts in rank order, a blank line between them."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), "\n\n")
    return contexts.groupBy("qid").agg(text.alias("context"))


def prompts(questions: DataFrame, template: str, context: DataFrame | None = None) -> DataFrame:
    """(qid, prompt, key): placeholders {question} and {context} filled; key is the prompt's hash."""
    rows = questions.join(context, "qid", "left") if context is not None else questions.withColumn("context", F.lit(""))
    text = F.replace(F.replace(F.lit(template), F.lit("{context}"), F.coalesce("context", F.lit(""))), F.lit("{question}"), F.col("question"))
    return rows.select("qid", text.alias("prompt")).withColumn("key", F.sha2("prompt", 256))


def missing_placeholders(template: Column, wanted: list[str]) -> Column:
    """Wanted placeholders that a template lacks."""
    return F.array_except(F.array(*map(F.lit, wanted)), F.regexp_extract_all(template, F.lit(r"\{(\w+)\}"), F.lit(1)))


def answers(prompted: DataFrame, replies: DataFrame, llm: str, generate=None) -> DataFrame:
    """(qid, answer, tokens): replies known by (llm, key) first; ``generate``, a DataFrame function of (key, prompt), for the others."""
    known = replies.where(F.col("llm") == llm).select("key", "reply")
    if generate is not None:
        new = generate(prompted.select("key", "prompt").distinct().join(known, "key", "left_anti"))
        known = known.unionByName(new.select("key", "reply"))
    out = prompted.join(known, "key", "left").select("qid", F.btrim("reply").alias("answer"))
    return out.withColumn("tokens", F.when(F.col("answer").isNull(), 0).otherwise(F.size(F.filter(F.split("answer", r"(?U)\s+"), lambda x: x != ""))))


def oracle_contexts(questions: DataFrame) -> DataFrame:
    """Annotated evidence (qid, evidence array) in its order as contexts; questions without evidence drop out."""
    return questions.where(F.size("evidence") > 0).select("qid", F.posexplode("evidence").alias("p", "text")).select("qid", (F.col("p") + 1).alias("rank"), "text", F.lit("oracle").alias("source"))


def parsed_ranking(reply: Column, n: Column) -> Column:
    """Places (from 0) in the order of the reply's numbers, out-of-range ones and repeats dropped, missing ones appended."""
    numbers = F.transform(F.regexp_extract_all(reply, F.lit(r"(\d+)"), F.lit(1)), lambda x: F.try_to_number(x, F.lit("999999999")).cast("int"))
    named = F.array_distinct(F.filter(numbers, lambda x: x.isNotNull() & (x >= 0) & (x < n)))
    return F.when(n <= 0, F.array().cast("array<int>")).otherwise(F.concat(named, F.array_except(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), named)))


def rerank(contexts: DataFrame, replies: DataFrame, keep: int = 3) -> DataFrame:
    """The ``keep`` contexts that the reply (qid, reply) ranks highest."""
    n = contexts.groupBy("qid").agg(F.count("*").cast("int").alias("n")).join(replies, "qid", "left")
    order = n.select("qid", F.posexplode(parsed_ranking(F.coalesce("reply", F.lit("")), F.col("n"))).alias("new", "old")).where(F.col("new") < keep)
    numbered = contexts.withColumn("old", F.row_number().over(Window.partitionBy("qid").orderBy("rank")) - 1)
    return numbered.join(order.hint("merge"), ["qid", "old"]).drop("rank", "old").withColumn("rank", F.col("new") + 1).drop("new")


def insufficient(verdict: Column) -> Column:
    return F.upper(F.btrim(verdict)).startswith("INSUFICIENTE")


def corrected(contexts: DataFrame, verdicts: DataFrame, second: DataFrame) -> DataFrame:
    """Contexts of questions judged sufficient, and the second retrieval's for the others."""
    bad = verdicts.where(insufficient(F.col("verdict"))).select("qid")
    return contexts.join(bad, "qid", "left_anti").unionByName(second.join(bad, "qid", "left_semi"))


def compressed(contexts: DataFrame, extracts: DataFrame) -> DataFrame:
    """One extract (qid, extract) in the contexts' place, with score 1 and source compression; nothing without contexts."""
    asked = contexts.select("qid").distinct()
    return extracts.join(asked.hint("merge"), "qid", "left_semi").select("qid", F.lit(1).alias("rank"), F.col("extract").alias("text"), F.lit(1.0).alias("score"), F.lit("compression").alias("source"))


def compressed_blocks(questions: DataFrame, contexts: DataFrame, extracts: DataFrame) -> DataFrame:
    """(qid, context) of every question's answer prompt: its extract, or an empty context where nothing was retrieved."""
    text = compressed(contexts, extracts).select("qid", F.btrim("text").alias("context"))
    return questions.select("qid").join(text.hint("merge"), "qid", "left").withColumn("context", F.coalesce("context", F.lit("")))


def agent_step(reply: Column) -> tuple[Column, Column]:
    """(action, text): ANSWER: ends, SEARCH: asks again, other text ends."""
    t = F.btrim(reply)
    up = F.upper(t)
    body = F.btrim(F.regexp_replace(t, r"^[^:]*:", ""))
    return F.when(up.startswith("SEARCH:"), "search").otherwise("answer").alias("action"), F.when(up.startswith("SEARCH:") | up.startswith("ANSWER:"), body).otherwise(t).alias("text")


def agentic(rounds: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(qid, answer, rounds): ``rounds`` are (replies, contexts) of up to three turns; contexts pile up, repeats included.

    A question is active until it answers; after the last turn the last reply stands.
    """
    active, done, seen = None, None, None
    for no, (replies, contexts) in enumerate(rounds, 1):
        now = replies if active is None else replies.join(active, "qid", "left_semi")
        action, text = agent_step(F.col("reply"))
        step = now.select("qid", action, text)
        ended = step.where((F.col("action") == "answer") | F.lit(no == len(rounds)))
        out = ended.select("qid", F.col("text").alias("answer"), F.lit(no).alias("rounds"))
        done = out if done is None else done.unionByName(out)
        active = step.where("action = 'search'").select("qid")
        more = contexts.join(active, "qid", "left_semi").select("qid", F.lit(no).alias("turn"), "rank", "text")
        seen = more if seen is None else seen.unionByName(more)
    return done.join(seen.groupBy("qid").agg(F.count("*").alias("contexts")), "qid", "left").fillna(0, ["contexts"])


def united(first: DataFrame, second: DataFrame, text: str = "text") -> DataFrame:
    """Two rankings interleaved, the first one ahead; of equal texts the first stays, with its columns; ranks anew."""
    rows = first.withColumn("p", F.col("rank") * 2).unionByName(second.withColumn("p", F.col("rank") * 2 + 1))
    once = F.row_number().over(Window.partitionBy("qid", text).orderBy("p"))
    kept = rows.withColumn("n", once).where("n = 1").drop("rank", "n")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("p"))).drop("p")

"""Conversations: lists, order, history, replies of small models. Messages are (conv_id, turn, role, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragbench.operators.signals import corpus_signals, question_signals, retrieval_signals
from ragbench.sources.shared import written


def dialogues(messages: DataFrame) -> DataFrame:
    """(conv_id, messages, first): number of messages and the first user message, cut to 80 characters."""
    user = F.when(F.col("role") == "user", F.struct("turn", "text"))
    return messages.groupBy("conv_id").agg(F.count("*").alias("messages"), F.substring(F.min(user)["text"], 1, 80).alias("first"))


def listed(rows: DataFrame, day: str | None = None, rated: bool | None = None, sort: str = "newest", page: int = 1, size: int = 20) -> DataFrame:
    """Dialogues (conv_id, created_at, rating) of a day, rated or not, sorted, by page; missing ratings come last."""
    if day:
        rows = rows.where((F.col("created_at") >= F.lit(day).cast("timestamp")) & (F.col("created_at") < F.lit(day).cast("timestamp") + F.expr("interval 1 day")))
    if rated is not None:
        rows = rows.where(F.col("rating").isNotNull() if rated else F.col("rating").isNull())
    order = {"newest": [F.desc("created_at")], "oldest": [F.asc("created_at")], "best": [F.desc_nulls_last("rating")], "worst": [F.asc_nulls_last("rating")]}[sort]
    return rows.orderBy(*order, "conv_id").offset((page - 1) * size).limit(size)


def ordered(messages: DataFrame) -> DataFrame:
    """One row for each dialogue with its messages in order."""
    return messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("messages"))


def history(messages: DataFrame) -> DataFrame:
    """Each message with the lines ``role: text`` before it."""
    line = F.concat_ws(": ", "role", "text")
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return messages.withColumn("history", F.array_join(F.collect_list(line).over(before), "\n"))


_QUOTES = "\"'`“” "


def triage(reply: Column) -> tuple[Column, Column]:
    """(route, query) of a reply's first line: DIRECT answers, RAG: question searches it, another question is searched as it stands."""
    trimmed = F.btrim(F.coalesce(reply, F.lit("")), F.lit(" \t\r\n"))
    first = F.btrim(F.element_at(F.split(trimmed, "\n"), 1), F.lit(_QUOTES + "\r\t"))
    upper = F.upper(first)
    rest = F.btrim(F.when(F.contains(first, F.lit(":")), F.regexp_replace(first, "^[^:]*:", "")).otherwise(""), F.lit(_QUOTES))
    route = F.when(upper.startswith("DIRECT"), "direct").otherwise("rag")
    query = F.when(upper.startswith("DIRECT"), "").when(upper.startswith("RAG"), rest).when(first.endswith("?"), first).otherwise("")
    return route.alias("route"), query.alias("query")


def blocked(reply: Column) -> Column:
    """Whether the guardrail's reply, quotes aside, begins with BLOCK."""
    return F.upper(F.btrim(F.coalesce(reply, F.lit("")), F.lit(_QUOTES + "\n\t"))).startswith("BLOCK")


def message_rows(saved: DataFrame) -> DataFrame:
    """A saved dialogue (conv_id, messages array) as message rows with positions."""
    return saved.select("conv_id", F.posexplode("messages").alias("position", "m")).select("conv_id", "position", "m.role", "m.text")


def rated(dialogues_: DataFrame, ratings: DataFrame) -> DataFrame:
    """Dialogues (conv_id, ...) with the last valid rating (conv_id, rating, rated_at): whole numbers from 0 to 10; others are not taken."""
    valid = ratings.where(F.col("rating").between(0, 10))
    last = valid.groupBy("conv_id").agg(F.max(F.struct("rated_at", "rating")).alias("r")).select("conv_id", "r.rating", "r.rated_at")
    return dialogues_.drop("rating", "rated_at").join(last.hint("merge"), "conv_id", "left")


def saved_configurations(log: DataFrame) -> DataFrame:
    """(config_id, name, ok): configurations in the order of their ids; a name that is taken, by one not deleted before, is refused.

    ``log`` has config_id, name and deleted_at (the id at which the configuration was deleted, or null). Names are
    compared within a name's own rows, in order: one row is taken if the last one taken was deleted by then.
    """
    step = lambda acc, x: F.when(
        acc["free"] <= x["config_id"],
        F.struct(F.coalesce(x["deleted_at"], F.lit(2**62)).alias("free"), F.concat(acc["ok"], F.array(x["config_id"])).alias("ok")),
    ).otherwise(acc)
    start = F.struct(F.lit(0).cast("long").alias("free"), F.array().cast("array<bigint>").alias("ok"))
    rows = log.select(F.col("config_id").cast("long"), "name", F.col("deleted_at").cast("long"))
    taken = rows.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("config_id", "deleted_at"))).alias("x")).select("name", F.aggregate("x", start, step)["ok"].alias("ok"))
    return rows.join(taken.hint("merge"), "name").select("config_id", "name", F.array_contains("ok", F.col("config_id")).alias("ok"))


def turn_difficulty(turns: DataFrame, df: DataFrame, n_docs: int, hits: DataFrame) -> DataFrame:
    """One row for each turn (qid, question, searched): its question, corpus and retrieval signals.

    Question and corpus signals are those of the searched text, or of the question where nothing was searched; ``df`` and ``n_docs`` are the
    base's document frequencies and size. Retrieval signals come from the turn's ``hits`` (qid, score) and are null without any.
    """
    texts = written(turns.select("qid", F.coalesce(F.nullif(F.btrim("searched"), F.lit("")), "question").alias("text")), "turn-texts")
    asked = texts.select("qid", *question_signals(F.col("text")))
    return asked.join(corpus_signals(texts, df, n_docs), "qid", "left").join(retrieval_signals(hits), "qid", "left")

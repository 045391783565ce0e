"""The tables that stand in for documents, chunks, questions and results, as DataFrames and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, base, text)."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.col("lang").alias("base"), "text")


def short_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, name): sentences of 8 to 32 characters, whole; each once for a document."""
    cut = docs(spark, sf_dir).where("text is not null").select("doc", F.explode(F.split("text", r"[.\n]")).alias("name")).select("doc", F.btrim("name").alias("name"))
    return cut.where("length(name) BETWEEN 8 AND 32").distinct()


#: Vectors as chunks: document = label, position = order of the id within it.
CHUNK_SQL = "c AS (SELECT vec_id AS chunk_id, label AS doc, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1)::INT AS chunk_index, embedding::DOUBLE[] AS vector FROM embeddings)"


def vector_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    e = table(spark, sf_dir, "embeddings")
    index = (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).cast("int")
    return e.select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("doc"), index.alias("chunk_index"), F.col("embedding").alias("vector"), F.concat(F.lit("v"), "vec_id").alias("text"))


def vector_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 20."""
    return table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"), "label")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, conv_id, answer, reference): an assistant turn against the user turn before it."""
    c = table(spark, sf_dir, "conversations")
    user = c.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("reference"))
    return c.where("role = 'assistant'").join(user, ["conv_id", "turn"]).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "conv_id", F.col("text").alias("answer"), "reference")


TURN_SQL = """tn AS (SELECT a.conv_id * 1000 + a.turn AS id, a.conv_id, a.text AS answer, u.text AS reference FROM conversations a JOIN conversations u
  ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' AND u.role = 'user')"""


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as result rows: a combination answers a question (the part); some rows are errors."""
    li, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    kind = F.element_at(F.array(*map(F.lit, ("simples", "ponte", "comparacao", "agregacao"))), (F.col("p_size") % 4 + 1).cast("int"))
    rag = F.element_at(F.array(*map(F.lit, ("naive", "closed_book", "oracle"))), (F.col("l_linenumber") % 3 + 1).cast("int"))
    return li.join(part, li["l_partkey"] == part["p_partkey"]).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("result_id"), F.col("l_partkey").alias("question"), kind.alias("question_type"), rag.alias("rag"),
        F.concat(F.lit("ret"), "l_returnflag").alias("retriever"), F.concat(F.lit("llm"), "l_linestatus").alias("llm"), (F.col("l_suppkey") % 2).alias("base"),
        F.concat_ws("/", rag, F.concat(F.lit("ret"), "l_returnflag"), F.concat(F.lit("llm"), "l_linestatus")).alias("combo"),
        F.when(F.col("l_quantity") >= 49, "[ERRO: timeout").otherwise("ok").alias("answer"),
        F.round(F.col("l_discount") * 10, 6).alias("chrf"), F.round(1 - F.col("l_tax") * 10, 6).alias("token_f1"),
        F.when(F.col("l_linenumber") < 6, (F.col("l_quantity") > 25).cast("double")).alias("context_hit"),
        F.col("l_extendedprice").alias("latency_ms"), F.col("l_quantity").alias("tokens"), F.col("l_shipdate").alias("ts"), F.col("l_orderkey").alias("experiment"),
    )


RESULT_SQL = """r AS (SELECT l_orderkey * 10 + l_linenumber AS result_id, l_partkey AS question,
  ['simples', 'ponte', 'comparacao', 'agregacao'][p_size % 4 + 1] AS question_type, ['naive', 'closed_book', 'oracle'][l_linenumber % 3 + 1] AS rag,
  'ret' || l_returnflag AS retriever, 'llm' || l_linestatus AS llm, l_suppkey % 2 AS base,
  concat_ws('/', ['naive', 'closed_book', 'oracle'][l_linenumber % 3 + 1], 'ret' || l_returnflag, 'llm' || l_linestatus) AS combo,
  CASE WHEN l_quantity >= 49 THEN '[ERRO: timeout' ELSE 'ok' END AS answer, round(l_discount * 10, 6) AS chrf, round(1 - l_tax * 10, 6) AS token_f1,
  CASE WHEN l_linenumber < 6 THEN (l_quantity > 25)::INT::DOUBLE END AS context_hit, l_extendedprice AS latency_ms, l_quantity AS tokens, l_shipdate AS ts, l_orderkey AS experiment
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""
METRICS = ("chrf", "token_f1", "context_hit")


def long_scores(rows: DataFrame, keep: tuple[str, ...] = (), metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """(combo, question, question_type, ..., metric, value): one row for each of ``metrics`` that a result has."""
    pairs = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics))
    return rows.select("result_id", "combo", "rag", "retriever", "llm", "base", "question", "question_type", "answer", *keep, F.explode(pairs).alias("m")).select("*", "m.metric", "m.value").drop("m").where("value is not null")


LONG_SQL = "s AS (" + " UNION ALL ".join(f"SELECT result_id, combo, rag, retriever, llm, base, question, question_type, answer, '{m}' AS metric, {m} AS value FROM r WHERE {m} IS NOT NULL" for m in METRICS) + ")"

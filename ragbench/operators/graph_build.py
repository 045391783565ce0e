"""Build or reuse the graph of an index's chunks: a run can break anywhere and the next one goes on from what was finished."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragbench.operators import graph
from ragbench.sources.tables import graph_texts

CACHE_SCHEMA = "key string, lines array<struct<line_no:int,kind:string,a:string,b:string,type:string,keywords:string,description:string>>"
PARTS = ("entities", "relations", "synonyms")


class EveryChunkFailed(RuntimeError):
    """No chunk's extraction came back."""


def fingerprint(chunks: DataFrame) -> str:
    """Of (chunk_id, text), whatever the order of the rows: their number and sums of two hashes."""
    hashed = [F.xxhash64("chunk_id", "text", F.lit(seed)).cast("decimal(20,0)") for seed in (1, 2)]
    n, *sums = chunks.agg(F.count(F.lit(1)), *(F.coalesce(F.sum(h), F.lit(0)) for h in hashed)).first()
    return "-".join(f"{int(x) % 2**64:x}" for x in (n, *sums))


def _table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    try:
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    except AnalysisException:
        return None


def graph_place(chunks: DataFrame, place: str, extractor: str, prompt_version: str, graph_version: str) -> str:
    """The folder of the graph that fits these chunks and both versions."""
    return f"{place}/{extractor}/graphs/{fingerprint(chunks)}-{prompt_version}-{graph_version}"


def current_graph(spark: SparkSession, path: str) -> dict[str, DataFrame] | None:
    """The parts of a finished graph, its stats as ``meta``; None if it was never finished."""
    meta = _table(spark, f"{path}/meta")
    if meta is None or meta.isEmpty():
        return None
    run = meta.first()["run"]
    return {part: spark.read.parquet(f"{path}/{run}/{part}") for part in PARTS} | {"meta": meta}


def ensure_graph(chunks: DataFrame, place: str, extractor: str, extract: Callable[[DataFrame], DataFrame], prompt_version: str = "1", graph_version: str = "1") -> dict[str, DataFrame]:
    """The current graph of the chunks (chunk_id, text) for this extractor, built first if it is missing or stale.

    ``extract`` gets the chunks (chunk_id, key, body) that the cache below ``place`` lacks and returns (chunk_id, reply), the reply null where
    the model call failed. Replies are cached before anything is built on them, failed ones are not, so a later run asks for those alone.
    Entities, relations and synonyms go to a folder of this run; the meta row, written last, names it. A run that breaks leaves
    cached replies and no graph. Chunks that failed are counted in the meta row; if all did, it is an error and there is no graph.
    """
    spark = chunks.sparkSession
    path = graph_place(chunks, place, extractor, prompt_version, graph_version)
    if (found := current_graph(spark, path)) is not None:
        return found
    body = graph.without_headings(F.coalesce("text", F.lit("")))
    keyed = chunks.select("chunk_id", body.alias("body")).withColumn("key", graph.extraction_key(F.lit(extractor), F.lit(prompt_version), F.col("body")))
    cache_path, run = f"{place}/{extractor}/cache", uuid.uuid4().hex
    cache = _table(spark, cache_path, CACHE_SCHEMA)
    if cache is None:
        spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache_path)
        cache = spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
    asked = f"{path}/{run}/replies"
    missing = graph.missing_extractions(keyed, cache)
    # Equal chunks are asked for once.
    one = missing.groupBy("key").agg(F.min(F.struct("chunk_id", "body")).alias("c")).select("c.chunk_id", "key", "c.body")
    extract(one).select("chunk_id", "reply").write.parquet(asked)
    graph.to_cache(keyed, spark.read.parquet(asked), cache).write.mode("append").parquet(cache_path)

    cache = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).dropDuplicates(["key"])
    met = keyed.select("chunk_id", "key").join(cache, "key", "left")
    met.select("chunk_id", "lines").write.parquet(f"{path}/{run}/extractions")
    met = spark.read.parquet(f"{path}/{run}/extractions")
    lines = met.select("chunk_id", F.explode("lines").alias("l")).select("chunk_id", "l.*")
    entities = graph.merge_entities(lines)
    relations, promoted = graph.merge_relations(lines, entities)
    columns = ["key", "name", "type", "description", "chunk_ids", "aliases"]
    none = promoted.withColumns({"description": F.lit(""), "aliases": F.array().cast("array<string>")})
    entities, relations = graph_texts(entities.select(*columns).unionByName(none.select(*columns)), relations)
    entities.write.parquet(f"{path}/{run}/entities")
    relations.write.parquet(f"{path}/{run}/relations")
    entities, relations = (spark.read.parquet(f"{path}/{run}/{part}") for part in ("entities", "relations"))
    graph.synonyms(entities.select("key", "name")).write.parquet(f"{path}/{run}/synonyms")
    stats = graph.build_stats(lines, met.select("chunk_id", F.when(F.col("lines").isNotNull(), "").alias("reply")), entities, relations).first()
    if stats["error"] is not None:
        raise EveryChunkFailed(stats["error"])
    spark.createDataFrame([(run, *(stats[c] for c in ("entities", "relations", "chunks", "lines", "failed_lines", "failed_chunks")))], "run string, entities long, relations long, chunks long, lines long, failed_lines long, failed_chunks long").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")
    return current_graph(spark, path)

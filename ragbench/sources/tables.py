"""Scans, index catalogues and sinks."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ragbench.functions.text import split_list
from ragbench.operators.graph import bridges_found

QUESTION_TYPES = ("simples", "ponte", "comparacao", "agregacao")
#: Column names of question files.
Q_TEXT, Q_REFERENCE, Q_EVIDENCE, Q_TYPE, Q_HOPS, Q_BRIDGES = "pergunta", "resposta_referencia", "evidencia_referencia", "tipo", "evidencia_salto", "entidades_ponte"
MARKER = "__kg_"


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Question files as text columns; absent optional columns are null. The question column is required."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    if Q_TEXT not in raw.columns:
        raise ValueError(f"CSV missing required column: {Q_TEXT}")
    return raw.select(*(F.col(c) if c in raw.columns else F.lit(None).cast("string").alias(c) for c in (Q_TEXT, Q_REFERENCE, Q_EVIDENCE, Q_TYPE, Q_HOPS, Q_BRIDGES)))


def parse_questions(raw: DataFrame) -> DataFrame:
    """question, reference, question_type, evidence (passage, hop), bridge_entities and ``error``, null for good rows; blank questions drop out."""
    passages, hops = split_list(F.col(Q_EVIDENCE)), split_list(F.col(Q_HOPS))
    kind = F.coalesce(F.nullif(F.btrim(Q_TYPE), F.lit("")), F.lit(QUESTION_TYPES[0]))
    rows = raw.where(F.coalesce(F.btrim(Q_TEXT), F.lit("")) != "").withColumns({"_p": passages, "_h": hops, "_k": kind})
    bad_hops = (F.size("_h") > 0) & ((F.size("_h") != F.size("_p")) | F.exists("_h", lambda h: ~h.rlike(r"^\d+$") | (F.try_to_number(h, F.lit("999999999")) < 1)))
    error = F.when(~F.col("_k").isin(*QUESTION_TYPES), F.concat(F.lit("unknown tipo "), "_k")).when(bad_hops, "one hop number (1, 2, ...) is needed for each passage")
    numbers = F.when(F.size("_h") == 0, F.transform("_p", lambda _: F.lit(1))).otherwise(F.transform("_h", lambda h: F.coalesce(F.try_to_number(h, F.lit("999999999")).cast("int"), F.lit(0))))
    pairs = F.arrays_zip(F.col("_p").alias("passage"), numbers.alias("hop"))
    return rows.select(F.btrim(Q_TEXT).alias("question"), F.nullif(F.btrim(Q_REFERENCE), F.lit("")).alias("reference"), F.col("_k").alias("question_type"), pairs.alias("evidence"), split_list(F.col(Q_BRIDGES)).alias("bridge_entities"), error.alias("error"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole UTF-8 files: (path, doc: the file's name, text)."""
    name = F.input_file_name()
    return spark.read.text(path, wholetext=True).select(name.alias("path"), F.element_at(F.split(name, "/"), -1).alias("doc"), F.col("value").alias("text"))


def numbered(chunks: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """chunk_id within each index (base, chunking, embedding) by (doc, chunk_index), going on from the rows that exist."""
    index = ["base", "chunking", "embedding"]
    rows = chunks.withColumn("chunk_id", F.row_number().over(Window.partitionBy(*index).orderBy("doc", "chunk_index")).cast("long") - 1)
    if existing is None:
        return rows
    held = existing.groupBy(*index).agg(F.count("*").alias("_n"))
    return rows.join(held, index, "left").withColumn("chunk_id", F.col("chunk_id") + F.coalesce("_n", F.lit(0))).drop("_n")


def append_chunks(chunks: DataFrame, path: str) -> None:
    """Append to the index table, stamped with the time; one partition folder for each index."""
    chunks.withColumn("ingested_at", F.current_timestamp()).write.mode("append").partitionBy("base", "chunking", "embedding").parquet(path)


def scan(rows: DataFrame, equal: dict | None = None, ranges: dict | None = None, limit: int | None = None) -> DataFrame:
    """Rows with equal values and inclusive ranges; conditions reach the Parquet scan."""
    for c, v in (equal or {}).items():
        rows = rows.where(F.col(c) == v)
    for c, (lo, hi) in (ranges or {}).items():
        rows = rows.where(F.col(c).between(lo, hi))
    return rows.limit(limit) if limit is not None else rows


def catalogue(chunks: DataFrame, graphs: DataFrame | None = None) -> DataFrame:
    """(base, indexes): each index with its number of chunks and, where graphs (base, chunking, embedding, extractor, lines, failed) exist, their failed share."""
    keys = ["base", "chunking", "embedding"]
    n = chunks.groupBy(*keys).agg(F.count("*").alias("chunks"))
    if graphs is None:
        return n
    share = F.when(F.col("lines") > 0, F.round(100.0 * F.col("failed") / F.col("lines"), 1)).otherwise(0.0)
    g = graphs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("extractor", share.alias("failed_pct")))).alias("graphs"))
    return n.join(g, keys, "left")


def without_base(rows: DataFrame, base: str) -> DataFrame:
    """All rows but those of a base, by its exact name."""
    return rows.where(~F.col("base").eqNullSafe(base))


def index_name(base: Column, chunking: Column, embedding: Column) -> Column:
    return F.concat_ws("__", base, chunking, embedding)


def parse_index_name(name: Column) -> Column:
    """(base, chunking, embedding) from the right; null for graph names and names with fewer parts."""
    pattern = r"^(.*)__((?:(?!__).)*)__((?:(?!__).)*)$"
    parts = F.struct(*(F.regexp_extract(name, pattern, i).alias(n) for i, n in enumerate(("base", "chunking", "embedding"), 1)))
    return F.when(~F.contains(name, F.lit(MARKER)) & name.rlike(pattern), parts)


def graph_names(index: Column, extractor: Column) -> Column:
    """(entities, relations) names; an extractor that had to be spelt otherwise carries a short hash."""
    plain = F.btrim(F.regexp_replace(extractor, r"[^A-Za-z0-9.-]+", "-"), F.lit("-"))
    safe = F.when(plain == extractor, plain).otherwise(F.concat(plain, F.lit("-"), F.substring(F.sha1(extractor), 1, 8)))
    return F.struct(F.concat(index, F.lit(MARKER + "ent__"), safe).alias("entities"), F.concat(index, F.lit(MARKER + "rel__"), safe).alias("relations"))


def valid_base_name(name: Column) -> Column:
    """1 to 64 letters, digits, spaces, hyphens or single underscores, without spaces or hyphens at the ends."""
    return ~F.contains(name, F.lit("__")) & name.rlike(r"^[\p{L}\p{N}_](?:[\p{L}\p{N}_ -]{0,62}[\p{L}\p{N}_])?$")


def evolve(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of both; columns that one lacks are null there."""
    return old.unionByName(new, allowMissingColumns=True)


def results_wide(scores: DataFrame, keys: list[str], metrics: list[str] | None = None) -> DataFrame:
    """One column for each metric, and their row mean. Without a list, the metric names (few) are read first."""
    names = metrics or sorted(r[0] for r in scores.select("metric").distinct().collect())
    wide = (F.first(F.when(F.col("metric") == n, F.col("value")), ignorenulls=True).alias(n) for n in names)
    return scores.groupBy(*keys).agg(*wide, F.avg("value").alias("media"))


def csv_cell(cell: Column) -> Column:
    """Cells that a spreadsheet would run as a formula get a quote in front."""
    return F.when(cell.rlike(r"^[=+@-]"), F.concat(F.lit("'"), cell)).otherwise(cell)


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV with a header, text cells quoted against formulas."""
    texts = {c for c, t in rows.dtypes if t == "string"}
    rows.select(*(csv_cell(F.col(c)).alias(c) if c in texts else F.col(c) for c in rows.columns)).write.mode("overwrite").csv(path, header=True, escape='"')


def comparison_rows(compared: DataFrame, others: DataFrame | None = None, means: DataFrame | None = None, types: tuple[str, ...] = QUESTION_TYPES) -> DataFrame:
    """Comparison export, numbers with 6 decimals: the paired items with a column for each question type, then items of other bases.

    ``compared`` has combo, scope (all or a type), n and mean_diff, and low, high and significant where intervals were
    drawn; ``others`` combo, n, mean; ``means`` combo and the metric's mean.
    """
    number = lambda c: F.when(c.isNotNull(), F.format_string("%.6f", F.round(c, 6) + 0.0))
    cell = lambda scope, c: F.max(F.when(F.col("scope") == scope, F.col(c)))
    columns = [cell("all", "n").alias("perguntas"), number(cell("all", "mean_diff")).alias("diferenca")]
    if "low" in compared.columns:
        yes = F.when(cell("all", "significant"), "sim").otherwise("não")
        columns += [number(cell("all", "low")).alias("ic_inferior"), number(cell("all", "high")).alias("ic_superior"), yes.alias("significativa")]
    rows = compared.groupBy("combo").agg(*columns, *(number(cell(t, "mean_diff")).alias(f"diferenca_{t}") for t in types)).withColumn("pareamento", F.lit("pareado"))
    if means is not None:
        rows = rows.join(means.select("combo", number(F.col("mean")).alias("media")).hint("merge"), "combo", "left")
    if others is not None:
        extra = [number(F.col(c)).alias(name) for c, name in (("low", "ic_inferior"), ("high", "ic_superior")) if c in others.columns]
        other = others.select("combo", F.col("n").alias("perguntas"), number(F.col("mean")).alias("media"), F.lit("outra Base").alias("pareamento"), *extra)
        rows = rows.unionByName(other, allowMissingColumns=True)
    return rows


def annotation_rows(notes: DataFrame, final: DataFrame, items: DataFrame | None = None, metrics: tuple[str, ...] = ()) -> DataFrame:
    """Annotation export: one row for each note and dimension with the final note and, of ``items`` (item, scores map), the automatic metrics."""
    rows = notes.join(final.select("item", "dim", "final", "status").hint("merge"), ["item", "dim"], "left")
    if items is not None:
        rows = rows.join(items.select("item", "scores").hint("merge"), "item", "left")
    return rows.select("item", csv_cell(F.col("annotator")).alias("annotator"), "dim", "score", "final", "status", *(F.try_element_at("scores", F.lit(m)).alias(m) for m in metrics))


def experiment_page(experiments: DataFrame, base: str | None = None, page: int = 1, size: int = 20) -> DataFrame:
    """A page of experiments (experiment, base, ...), newest first, of one base if given, each row with the total."""
    rows = experiments.where(F.col("base") == base) if base is not None else experiments
    total = rows.agg(F.count("*").alias("total"))  # one row
    return rows.orderBy(F.desc("experiment")).offset((page - 1) * size).limit(size).crossJoin(total)


def explode_dump(spark: SparkSession, path: str) -> DataFrame:
    """Result dumps of three shapes (list; {results: list}; {combination: {question: row}}) as (combo, question, row) text."""
    raw = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    shapes = raw.select(
        F.coalesce(F.try_variant_get("v", "$.results", "array<string>"), F.try_variant_get("v", "$", "array<string>")).alias("rows"),
        F.try_variant_get("v", "$", "map<string,map<string,string>>").alias("m"),
    )
    made = lambda combo, question, row: F.struct(combo.alias("combo"), question.alias("question"), row.alias("row"))
    nothing = F.lit(None).cast("string")
    flat = F.transform("rows", lambda row: made(nothing, nothing, row))
    # Both in one pass, so that each file is opened and parsed once; a dump that has rows is no map of maps.
    answers = lambda c: F.transform(F.map_entries(c["value"]), lambda q: made(c["key"], q["key"], q["value"]))
    deep = F.flatten(F.transform(F.filter(F.map_entries("m"), lambda c: c["value"].isNotNull()), answers))
    return shapes.select(F.explode(F.coalesce(flat, deep)).alias("r")).select("r.combo", "r.question", "r.row")


def write_graph(entities: DataFrame, relations: DataFrame, meta: DataFrame, path: str) -> None:
    """Entities and relations first; the meta row, written last, makes the graph complete."""
    entities.write.mode("overwrite").parquet(f"{path}/entities")
    relations.write.mode("overwrite").parquet(f"{path}/relations")
    meta.write.mode("overwrite").parquet(f"{path}/meta")


def complete_only(rows: DataFrame, meta: DataFrame) -> DataFrame:
    """Rows of graphs whose meta row is there."""
    return rows.join(meta.select("graph").distinct(), "graph", "left_semi")


def graph_texts(entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both with ``text``, what is embedded of an entity (name: description) and of a relation (keywords source target description)."""
    words = F.btrim(F.regexp_replace(F.concat_ws(" ", "keywords", "source", "target", "description"), r"\s+", " "))
    return entities.withColumn("text", F.concat_ws(": ", "name", F.nullif("description", F.lit("")))), relations.withColumn("text", words)


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame] | None:
    """(entities, relations) of a graph that :func:`write_graph` has completed; None without its meta row."""
    try:
        complete = not spark.read.parquet(f"{path}/meta").isEmpty()
    except AnalysisException:
        return None
    return (spark.read.parquet(f"{path}/entities"), spark.read.parquet(f"{path}/relations")) if complete else None


def options(chunks: DataFrame, graphs: DataFrame, registered: dict[str, list[str]] | None = None) -> DataFrame:
    """By base: its indexes, the extractors that have a graph of one of them, and what is registered by kind (chunkers, ...)."""
    i = chunks.groupBy("base").agg(F.array_sort(F.collect_set(F.concat_ws("/", "chunking", "embedding"))).alias("indexes"))
    g = graphs.groupBy("base").agg(F.array_sort(F.collect_set("extractor")).alias("extractors"))
    named = [F.array(*map(F.lit, sorted(names))).alias(kind) for kind, names in (registered or {}).items()]
    return i.join(g.hint("merge"), "base", "left").select("*", *named)


def flatten_results(runs: DataFrame, results: DataFrame, profiles: DataFrame) -> DataFrame:
    """One row for each run and question with defaults for what old rows lack.

    Results may have hops (array of hop and found; empty where nothing was retrieved), bridge_entities and graph_names
    (null without a graph): from these come hops_found and bridges_found.
    """
    joined = results.join(runs.hint("merge"), "run_id").join(profiles.hint("merge"), ["experiment_id", "question"], "left")
    joined = joined.withColumn("question_type", F.coalesce("question_type", F.lit(QUESTION_TYPES[0]))).withColumn("llm", F.coalesce("llm", F.lit("gemini")))
    if "hops" in joined.columns:
        joined = joined.withColumn("hops_found", F.coalesce("hops", F.array().cast(joined.schema["hops"].dataType))).drop("hops")
    if "graph_names" in joined.columns:
        joined = joined.withColumn("bridges_found", bridges_found(F.col("bridge_entities"), F.col("graph_names")))
    return joined


def pair_annotation_rows(notes: DataFrame, results: DataFrame) -> DataFrame:
    """Pairwise export: one row for each unblinded note (question, annotator, winner, reasons) with both results' texts."""
    text = results.select(F.col("result_id"), F.col("answer"))
    one, two = text.select(F.col("result_id").alias("result_1"), F.col("answer").alias("answer_1")), text.select(F.col("result_id").alias("result_2"), F.col("answer").alias("answer_2"))
    joined = notes.join(one, "result_1", "left").join(two, "result_2", "left")
    return joined.select("question", csv_cell(F.col("annotator")).alias("annotator"), "winner", F.array_join("reasons", "|").alias("reasons"), csv_cell(F.col("answer_1")).alias("answer_1"), csv_cell(F.col("answer_2")).alias("answer_2"))

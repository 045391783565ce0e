"""The experiment grid and its resumption, as data."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Techniques that do not retrieve, and those of them that read no index either.
NO_RETRIEVER, NO_INDEX = ("closed_book", "oracle"), ("closed_book", "oracle")


def expand(llms: DataFrame, indexes: DataFrame, rags: DataFrame, retrievers: DataFrame) -> DataFrame:
    """All runs of a configuration: (llm, chunking, embedding, rag, retriever) with ``place``, model-major.

    Each input has its values and ``no``, their order. A technique runs once for each thing that it reads: without
    a retriever it goes with the first one, without an index with the first index too. Inputs are short lists.
    """
    cells = llms.select("llm", F.col("no").alias("a")).crossJoin(indexes.select("chunking", "embedding", F.col("no").alias("b"))).crossJoin(rags.select("rag", F.col("no").alias("c"))).crossJoin(retrievers.select("retriever", F.col("no").alias("d")))
    first = F.min("d").over(Window.partitionBy()) == F.col("d")
    first_index = F.min("b").over(Window.partitionBy()) == F.col("b")
    kept = cells.withColumn("f", first).withColumn("i", first_index).where(~F.col("rag").isin(*NO_RETRIEVER) | (F.col("f") & (~F.col("rag").isin(*NO_INDEX) | F.col("i"))))
    return kept.select("llm", "chunking", "embedding", "rag", "retriever", F.row_number().over(Window.orderBy("a", "b", "c", "d")).alias("place"))


def distinct_combos(combos: DataFrame) -> DataFrame:
    """Explicit combinations (no, chunking, embedding, rag, retriever): of those that differ only in what the technique ignores the first stays."""
    used = combos.withColumn("_r", F.when(~F.col("rag").isin(*NO_RETRIEVER), F.col("retriever"))).withColumn("_i", F.when(~F.col("rag").isin(*NO_INDEX), F.concat_ws("|", "chunking", "embedding")))
    n = F.row_number().over(Window.partitionBy("rag", "_r", "_i").orderBy("no"))
    return used.withColumn("_n", n).where("_n = 1").select(*combos.columns)


def to_do(grid: DataFrame, questions: DataFrame, results: DataFrame) -> DataFrame:
    """(combo, question) pairs without a valid answer; error rows don't count, the oracle needs evidence."""
    valid = results.where(~F.col("answer").startswith("[ERRO: ")).select("combo", "question").distinct()
    # The grid, a product of short lists of a configuration, is the small side whatever the number of questions.
    wanted = questions.crossJoin(F.broadcast(grid)).where((F.col("rag") != "oracle") | F.col("has_evidence"))
    return wanted.select("combo", "question").join(valid.hint("merge"), ["combo", "question"], "left_anti")


def missing_evidence(rags: DataFrame, questions: DataFrame, needing: tuple[str, ...] = ("oracle",), by: tuple[str, ...] = ()) -> DataFrame:
    """(by, rag, error) for techniques that answer from reference evidence, when no question (evidence array) of the same ``by`` has any."""
    wanted = rags.where(F.col("rag").isin(*needing)).select(*by, "rag").distinct()
    some = questions.groupBy(*by).agg(F.coalesce(F.bool_or(F.size("evidence") > 0), F.lit(False)).alias("some"))
    lacking = wanted.join(some, list(by), "left") if by else wanted.crossJoin(some)  # without ``by`` one row
    return lacking.where("not coalesce(some, false)").select(*by, "rag", F.lit("needs reference evidence").alias("error"))


def missing_indexes(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    return wanted.join(existing, ["base", "chunking", "embedding"], "left_anti")


def fingerprint(chunks: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Order-free fingerprint of each group's rows: count, sum and xor of row hashes (no sort, no collection)."""
    h = F.xxhash64(*columns)
    return chunks.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.pmod(h, F.lit(2**40))).alias("total"), F.bit_xor(h).alias("mix"))


def fingerprint_changes(old: DataFrame, new: DataFrame, by: list[str]) -> DataFrame:
    """added, removed or changed groups between two fingerprints."""
    o, n = old.select(*by, F.struct("n", "total", "mix").alias("o")), new.select(*by, F.struct("n", "total", "mix").alias("w"))
    both = o.join(n, by, "full")
    change = F.when(F.col("o").isNull(), "added").when(F.col("w").isNull(), "removed").when(~F.col("o").eqNullSafe(F.col("w")), "changed")
    return both.select(*by, change.alias("change")).where("change is not null")


def failure_streaks(rows: DataFrame, by: str, order: list[str], least: int = 3) -> DataFrame:
    """(by, streak, n): runs of ``least`` or more failures in a row; a success ends a run."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    island = rows.withColumn("streak", F.sum(F.col("ok").cast("int")).over(w)).where(~F.col("ok"))
    return island.groupBy(by, "streak").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def progress(rows: DataFrame, total: DataFrame, by: str) -> DataFrame:
    """Done, total and remaining seconds at this pass's pace (rows have ts)."""
    s = rows.groupBy(by).agg(F.count("*").alias("done"), (F.max(F.col("ts").cast("timestamp")).cast("long") - F.min(F.col("ts").cast("timestamp")).cast("long")).alias("seconds"))
    out = total.join(s, by, "left").withColumn("done", F.coalesce("done", F.lit(0)))
    return out.select(by, "done", "total", F.when(F.col("done") > 0, F.col("seconds") * (F.col("total") - F.col("done")) / F.col("done")).alias("eta"))


def last_phase(log: DataFrame) -> DataFrame:
    """The last event of each experiment; those still running are marked paused."""
    last = log.groupBy("experiment").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"))
    return last.withColumn("status", F.when(F.col("status").isin("running", "scoring"), "paused").otherwise(F.col("status")))


def resumable(experiments: DataFrame, changed: DataFrame) -> DataFrame:
    """The first reason why an experiment can't be resumed; null if it can."""
    x = experiments.join(changed.select("experiment").distinct().withColumn("_c", F.lit(True)), "experiment", "left")
    reason = F.when(~F.col("status").isin("paused", "failed"), "not paused or failed").when(F.coalesce("questions", F.lit(0)) == 0, "no questions recorded").when(F.col("_c"), "inputs have changed")
    return x.select("experiment", "status", reason.alias("reason"))


def resumed(experiments: DataFrame, changed: DataFrame, requests: DataFrame) -> DataFrame:
    """(experiment, request, status, concurrency, error) of requests (request, experiment, concurrency or null) to resume.

    A request fails for the experiment's reason, or if its concurrency is not between 1 and the present one; of
    several that could succeed the first one wins and sets the experiment pending, as only one can flip it.
    """
    state = resumable(experiments, changed).select("experiment", "reason")
    rows = requests.withColumnRenamed("concurrency", "asked").join(state.hint("merge"), "experiment", "left").join(experiments.select("experiment", "concurrency", F.lit(True).alias("_k")).hint("merge"), "experiment", "left")
    outside = F.col("asked").isNotNull() & ~F.col("asked").between(1, F.coalesce("concurrency", F.lit(1)))
    error = F.when(F.col("_k").isNull(), "unknown experiment").when(F.col("reason").isNotNull(), F.col("reason")).when(outside, "concurrency out of range")
    rows = rows.withColumn("error", error)
    turn = F.row_number().over(Window.partitionBy("experiment", F.col("error").isNull()).orderBy("request"))
    rows = rows.withColumn("error", F.when(F.col("error").isNull() & (turn > 1), "resumed by another request").otherwise(F.col("error")))
    ok = F.col("error").isNull()
    return rows.select("experiment", "request", F.when(ok, "pending").alias("status"), F.when(ok, F.coalesce("asked", "concurrency")).alias("concurrency"), "error")


def pauses(log: DataFrame) -> DataFrame:
    """(experiment, no, paused_at, reason, questions_done): the pauses that took effect, in order.

    ``log`` has experiment, ts, event_id, kind (answer, request, pause or resume) and reason; a request without a pause
    after it is not one. The reason is the pause's, else that of the last request since the pause before, else manual.
    """
    w = Window.partitionBy("experiment").orderBy("ts", "event_id")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = log.withColumn("part", F.sum((F.col("kind") == "pause").cast("int")).over(upto) - (F.col("kind") == "pause").cast("int"))
    rows = rows.withColumn("done", F.sum((F.col("kind") == "answer").cast("int")).over(upto))
    asked = rows.groupBy("experiment", "part").agg(F.max(F.when(F.col("kind") == "request", F.struct("ts", "event_id", "reason")))["reason"].alias("asked"))
    taken = rows.where("kind = 'pause'").join(asked.hint("merge"), ["experiment", "part"], "left")
    return taken.select("experiment", (F.col("part") + 1).alias("no"), F.col("ts").alias("paused_at"), F.coalesce("reason", "asked", F.lit("manual")).alias("reason"), F.col("done").alias("questions_done"))


def list_conflicts(given: DataFrame, derived: DataFrame) -> DataFrame:
    """(config, dim) of configurations whose own list (config, dim, values) is neither empty nor that which the combinations give."""
    d = derived.select("config", "dim", F.col("values").alias("derived"))
    both = given.hint("merge").join(d, ["config", "dim"])
    return both.where((F.size("values") > 0) & ~F.col("values").eqNullSafe(F.col("derived"))).select("config", "dim")


def in_use(builds: DataFrame, experiments: DataFrame) -> DataFrame:
    """(base, reason): the first use of each base, builds before experiments, by id."""
    uses = builds.select("base", F.lit(0).alias("k"), "id").unionByName(experiments.select("base", F.lit(1).alias("k"), "id"))
    first = uses.groupBy("base").agg(F.min(F.struct("k", "id")).alias("u"))
    return first.select("base", F.concat(F.when(F.col("u.k") == 0, "build ").otherwise("experiment "), F.col("u.id").cast("string")).alias("reason"))


def derived_lists(combos: DataFrame, dims: list[str]) -> DataFrame:
    """(dim, no, value): the distinct values of each dimension in the order in which the combinations name them."""
    long = combos.select("no", F.explode(F.array(*(F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("value")) for d in dims))).alias("x")).select("no", "x.*")
    first = long.groupBy("dim", "value").agg(F.min("no").alias("at"))
    return first.select("dim", F.row_number().over(Window.partitionBy("dim").orderBy("at", "value")).alias("no"), "value")


def outcomes(attempts: DataFrame, most: int = 3) -> DataFrame:
    """(combo, question, answer): the first good reply of up to ``most`` attempts (no, reply, error), else the last error as an error row."""
    tried = attempts.where(F.col("no") <= most)
    good = F.min(F.when(F.col("error").isNull(), F.struct("no", "reply")))["reply"]
    bad = F.concat(F.lit("[ERRO: "), F.max(F.when(F.col("error").isNotNull(), F.struct("no", "error")))["error"], F.lit("]"))
    return tried.groupBy("combo", "question").agg(F.coalesce(good, bad).alias("answer"))


def active_builds(jobs: DataFrame) -> DataFrame:
    """Unfinished build jobs, newest first."""
    return jobs.where(F.col("status").isin("queued", "running")).orderBy(F.desc("created_at"), F.desc("id"))


def prompt_snapshot(prompts: DataFrame, used: DataFrame, graph_techniques: tuple[str, ...] = ("graph", "graph_mix")) -> DataFrame:
    """Prompts (technique, name, text) of the techniques used; graph techniques take the answer prompt of naive too."""
    extra = used.where(F.col("technique").isin(*graph_techniques)).select(F.lit("naive").alias("technique"))
    return prompts.join(used.select("technique").unionByName(extra).distinct(), "technique", "left_semi")

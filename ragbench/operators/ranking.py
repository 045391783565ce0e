"""Rankings and chart aggregates over result rows (combo, question, question_type, metric, value) in long form."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragbench.operators.ordered import in_ranges, running_sums
from ragbench.sources.shared import written


#: Rows of one task where all rows are grouped by result.
TASK_ROWS = 250_000


def row_means(results: DataFrame, metrics: tuple[str, ...], most: int | None = None) -> DataFrame:
    """Mean of all metrics (columns) that a result has; result rows of one id, combination, question and type are one result.

    Rows are dealt by question and combination to tasks whose number grows with the rows, as a task holds every result
    that it groups. ``most``: a number that the rows don't exceed, where it is known; else they are counted.
    """
    most = results.count() if most is None else most
    tasks = max(results.sparkSession.sparkContext.defaultParallelism, math.ceil(most / TASK_ROWS))
    total = sum((F.coalesce(F.col(m), F.lit(0.0)) for m in metrics), F.lit(0.0))
    has = sum((F.col(m).isNotNull().cast("int") for m in metrics), F.lit(0))
    rows = results.select("result_id", "combo", "question", "question_type", total.alias("total"), has.alias("has")).where("has > 0").repartition(tasks, "question", "combo")
    return rows.groupBy("result_id", "combo", "question", "question_type").agg((F.sum("total") / F.sum("has")).alias("media"))


def rank_combinations(means: DataFrame) -> DataFrame:
    """(combo, question_type, n, questions, media) of row means: by combination, by combination and type, by type.

    ``level`` says which; the combinations' own rows are ranked by falling media, missing ones last. All but the last
    groupings stay where :func:`row_means` has dealt the rows, but for a question's rows of the types' own level.
    """
    sums = [F.sum(c).alias(c) for c in ("n", "m", "s")]
    pairs = means.groupBy("question", "combo", "question_type").agg(F.count("*").alias("n"), F.count("media").alias("m"), F.sum("media").alias("s"))
    entry = lambda level, combo, kind: F.struct(F.lit(level).alias("level"), combo.alias("c"), kind.alias("t"))
    combo, kind, none = F.col("combo"), F.col("question_type"), lambda c: F.when(F.lit(False), c)
    levels = F.explode(F.array(entry("combo", combo, none(kind)), entry("combo_type", combo, kind), entry("type", none(combo), kind))).alias("e")
    each = pairs.select("question", "combo", "n", "m", "s", levels).select("*", "e.*").groupBy("question", "combo", "level", "c", "t").agg(*sums)
    # Combinations share a question at the types' own level only; elsewhere a row is a question's only one.
    of_type = F.col("level") == "type"
    asked = each.groupBy("level", "c", "t", F.when(of_type, F.col("question")).alias("q")).agg(*sums, F.count("question").alias("k"))
    sets = asked.groupBy(F.col("c").alias("combo"), F.col("t").alias("question_type"), "level").agg(
        F.sum("n").alias("n"), F.sum(F.when(of_type, (F.col("k") > 0).cast("long")).otherwise(F.col("k"))).alias("questions"), F.try_divide(F.sum("s"), F.sum("m")).alias("media")
    )
    place = F.rank().over(Window.partitionBy("level").orderBy(F.desc_nulls_last(F.round("media", 9)), "combo", "question_type"))
    return sets.select("combo", "question_type", "n", "questions", "media", "level").withColumn("place", place)


def metric_means(scores: DataFrame) -> DataFrame:
    """(combo, metric, n, mean): rows that lack a metric do not count for it."""
    return scores.groupBy("combo", "metric").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))


def best_of(means: DataFrame) -> DataFrame:
    """The greatest mean of each metric and a combination that has it (smallest name)."""
    return means.groupBy("metric").agg(F.max("mean").alias("best"), F.max_by("combo", F.struct("mean", F.expr("transform(split(combo, ''), c -> -ascii(c))"))).alias("combo"))


def page(rows: DataFrame, order: list[Column], number: int, size: int, where: Column | None = None) -> DataFrame:
    """Page ``number`` (from 1) of filtered rows in a total order."""
    return (rows.where(where) if where is not None else rows).orderBy(*order).offset((number - 1) * size).limit(size)


def metric_value(results: DataFrame, metric: str) -> DataFrame:
    """Mean of a metric with the rows that have it and all rows, by combination."""
    return results.groupBy("combo").agg(F.avg(metric).alias("value"), F.count(metric).alias("n"), F.count("*").alias("total"))


def focus(ranked: DataFrame, n: int, manual: list[str] = ()) -> DataFrame:
    """Top n and bottom n combinations (a top one is not also bottom) and those picked by hand; n is held within 1 and 10."""
    n = min(10, max(1, n))
    tops = ranked.orderBy(F.desc("media"), "combo").limit(n).select("combo", F.lit(0).alias("p"))
    lows = ranked.orderBy("media", F.desc("combo")).limit(n).select("combo", F.lit(1).alias("p"))
    hand = ranked.where(F.col("combo").isin(*manual)).select("combo", F.lit(2).alias("p")) if manual else ranked.limit(0).select("combo", F.lit(2).alias("p"))
    first = tops.unionByName(lows).unionByName(hand).groupBy("combo").agg(F.min("p").alias("p"))
    return ranked.join(F.broadcast(first), "combo").withColumn("focus", F.element_at(F.array(F.lit("top"), F.lit("bottom"), F.lit("manual")), F.col("p") + 1)).drop("p")


def metric_profile(scores: DataFrame, focused: DataFrame) -> DataFrame:
    """Means of the top and the bottom combinations by metric; the largest gaps first, the media last."""
    # At most 20 combinations and those picked by hand: broadcast, as scores sorted by so few names would meet in a few tasks.
    with_focus = scores.select("combo", "metric", "value").join(F.broadcast(focused.select("combo", "focus")), "combo")
    means = with_focus.groupBy("metric").agg(F.avg(F.when(F.col("focus") == "top", F.col("value"))).alias("top"), F.avg(F.when(F.col("focus") == "bottom", F.col("value"))).alias("bottom"))
    return means.withColumn("gap", F.col("bottom") - F.col("top"))


def dimension_effects(ranked: DataFrame, dims: list[str]) -> DataFrame:
    """For each dimension: options, best mean, worst mean and effect (best - worst); a dimension with one option is fixed."""
    stacked = ranked.select("media", F.explode(F.array(*(F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("option")) for d in dims))).alias("o")).select("media", "o.*")
    options = stacked.groupBy("dim", "option").agg(F.avg("media").alias("mean"), F.min("media").alias("low"), F.max("media").alias("high"))
    return options.groupBy("dim").agg(F.count("*").alias("options"), F.max("mean").alias("best"), F.min("mean").alias("worst"), F.min("low").alias("low"), F.max("high").alias("high")).withColumn(
        "effect", F.col("best") - F.col("worst")
    ).withColumn("fixed", F.col("options") == 1)


def grid_complete(ranked: DataFrame, dims: list[str]) -> DataFrame:
    """Whether there are as many combinations as the options' product."""
    counts = ranked.agg(F.countDistinct("combo").alias("combos"), *(F.countDistinct(d).alias(d) for d in dims))
    product = F.lit(1)
    for d in dims:
        product = product * F.col(d)
    return counts.select("combos", product.cast("long").alias("cells"), (F.col("combos") == product).alias("complete"))


def cost_points(results: DataFrame, quality: str) -> DataFrame:
    """Mean positive latency and tokens, and quality, by combination."""
    positive = lambda c: F.avg(F.when(F.col(c) > 0, F.col(c)))
    return results.groupBy("combo").agg(positive("latency_ms").alias("latency"), positive("tokens").alias("tokens"), F.avg(quality).alias("quality"))


def pareto(points: DataFrame, cost: str = "cost", quality: str = "quality", ranges: int = 64) -> DataFrame:
    """Points that no other beats: cost not above, quality not below, one of them strict. Equal points all stay.

    A point stays if its quality is the best at its cost and better than all at lower costs. The best of each cost
    range comes first, so the running best is found within ranges and over ``ranges`` rows, never over all points.
    """
    best = points.where(F.col(cost).isNotNull() & F.col(quality).isNotNull()).groupBy(cost).agg(F.max(quality).alias("_best"))
    edges = best.select(F.percentile_approx(cost, [i / ranges for i in range(1, ranges)]).alias("e")).first()["e"] or []
    part = F.lit(0)
    for e in sorted(set(edges)):
        part = part + (F.col(cost) > e).cast("int")
    best = best.withColumn("_part", part)
    tops = best.groupBy("_part").agg(F.max("_best").alias("_top"))  # at most ``ranges`` rows
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("_part", F.max("_top").over(before).alias("_above"))
    inner = Window.partitionBy("_part").orderBy(cost).rowsBetween(Window.unboundedPreceding, -1)
    kept = best.join(F.broadcast(tops), "_part").withColumn("_lower", F.greatest("_above", F.max("_best").over(inner)))
    kept = kept.where(F.col("_lower").isNull() | (F.col("_best") > F.col("_lower"))).select(F.col(cost).alias("_c"), "_best")
    return points.join(kept, (points[cost] == kept["_c"]) & (points[quality] == kept["_best"])).select(points["*"])


def quartiles(rows: DataFrame, by: str, value: str) -> DataFrame:
    return rows.groupBy(by).agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q")).select(by, *(F.col("q")[i].alias(n) for i, n in enumerate(("q1", "median", "q3"))))


def quantile_sketches(rows: DataFrame, by: list[str], value: str, k: int = 200) -> DataFrame:
    """(by, sketch): a KLL sketch of the values of each group, some kilobytes whatever the group's size.

    Sketches of parts (a day, a file) can be stored and merged, so quantiles over any of them need no second look at the rows.
    ``k`` sets the accuracy: at 200 a quantile's rank is off by 1.3 % of the rows at most, in 99 of 100 sketches.
    """
    return rows.where(F.col(value).isNotNull()).groupBy(*by).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias("sketch"))


def sketched_quantiles(sketches: DataFrame, by: list[str], at: dict[str, float]) -> DataFrame:
    """(by, n, a column for each quantile of ``at``) from stored sketches, merged by group."""
    merged = sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch").alias("sketch"))
    return merged.select(*by, F.kll_sketch_get_n_double("sketch").alias("n"), *(F.kll_sketch_get_quantile_double("sketch", F.lit(q)).alias(name) for name, q in at.items()))


def question_matrix(results: DataFrame, value: str) -> DataFrame:
    """(question, combo, value, difficulty): the first row of each cell and the question's mean over cells, nulls left out."""
    cell = results.groupBy("question", "combo").agg(F.min_by(value, F.struct("result_id", value)).alias("value"))
    mean = cell.groupBy("question").agg(F.avg("value").alias("difficulty"))
    return cell.join(mean, "question")


def latency_summary(log: DataFrame, level: str, latency: str, tokens: str) -> DataFrame:
    """By level: requests, median, p95 (nearest rank), requests and tokens per second of busy time, and speed-up against the lowest level."""
    s = log.groupBy(level).agg(F.count("*").alias("requests"), (F.sum(latency) / 1000).alias("seconds"), F.sum(tokens).alias("tokens"))
    # Equal latencies are counted, and their running sums over the order of all levels' say where the quantiles are.
    counts = written(log.where(F.col(latency).isNotNull()).groupBy(F.col(level).alias("level_of"), F.col(latency).alias("value")).agg(F.count("*").alias("n")), "latencies")
    sizes = counts.groupBy(F.col("level_of").alias("whose")).agg(F.sum("n").alias("size"))
    placed = running_sums(in_ranges(counts, ["level_of", "value"], "latencies"), ["level_of", "value"], {"upto": F.col("n")}, ["level_of"])
    placed = placed.join(F.broadcast(sizes), F.col("level_of").eqNullSafe(F.col("whose")))  # one row for each level
    at = lambda p: F.min(F.when(F.col("upto") >= p * F.col("size"), F.col("value")))
    quantiles = placed.groupBy("level_of").agg(at(0.5).alias("median"), at(0.95).alias("p95"))
    s = s.join(F.broadcast(quantiles), F.col(level).eqNullSafe(F.col("level_of")), "left").select(level, "requests", "median", "p95", "seconds", "tokens")
    rate = s.withColumn("req_s", F.col("requests") / F.col("seconds")).withColumn("tok_s", F.col("tokens") / F.col("seconds"))
    return rate.withColumn("speed_up", F.col("req_s") / F.first("req_s").over(Window.orderBy(level)))  # one row for each level

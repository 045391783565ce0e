"""Paired comparisons, bootstrap intervals and rank tests over (item, base, question, question_type, value)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragbench.sources.shared import written


def question_scores(scores: DataFrame) -> DataFrame:
    """Mean of a metric over the error-free answers of an item to a question."""
    ok = scores.where(~F.col("answer").startswith("[ERRO: ") & F.col("value").isNotNull())
    return ok.groupBy("combo", "base", "question", "metric").agg(F.avg("value").alias("value"), F.max("question_type").alias("question_type"))


class UnknownExperiment(LookupError):
    """An item names an experiment that does not exist."""


def requested(items: DataFrame, runs: DataFrame, experiments: DataFrame) -> DataFrame:
    """Each requested (experiment, combo), once, with ``reason`` null if the experiment has that run, else why it is left out.

    An experiment that isn't among ``experiments`` is an error, not a reason.
    """
    items = items.select("experiment", "combo").distinct()
    unknown = items.join(experiments.select("experiment").distinct(), "experiment", "left_anti").first()
    if unknown is not None:
        raise UnknownExperiment(f"experiment {unknown['experiment']} not found")
    known = runs.select("experiment", "combo").distinct().withColumn("k", F.lit(1))
    return items.join(known, ["experiment", "combo"], "left").select("experiment", "combo", F.when(F.col("k").isNull(), "unknown run").alias("reason"))


def default_metric(scores: DataFrame, preferred: tuple[str, ...]) -> DataFrame:
    """By item the first preferred metric that it has, else its smallest metric name."""
    order = F.lit(len(preferred))
    for i, m in reversed(list(enumerate(preferred))):
        order = F.when(F.col("metric") == m, i).otherwise(order)
    return scores.select("combo", "metric", order.alias("o")).distinct().groupBy("combo").agg(F.min(F.struct("o", "metric"))["metric"].alias("metric"))


def paired_differences(means: DataFrame, baseline: str) -> DataFrame:
    """(combo, base, question, question_type, diff) against the baseline on common questions of the same base; types are the baseline's."""
    b = means.where(F.col("combo") == baseline).select("base", "question", F.col("value").alias("bv"), F.col("question_type").alias("bt"))
    other = means.where(F.col("combo") != baseline).select("combo", "base", "question", "value")
    return other.join(b.hint("merge"), ["base", "question"]).select("combo", "base", "question", F.col("bt").alias("question_type"), (F.col("value") - F.col("bv")).alias("diff"))


def compare(means: DataFrame, baseline: str) -> DataFrame:
    """By item and type (``all`` for every type): common questions and the mean difference; one pass over grouping sets."""
    return _compared(paired_differences(means, baseline).withColumn("times", F.lit(1)))


def _compared(d: DataFrame) -> DataFrame:
    """:func:`compare` of differences that each stand for ``times`` questions."""
    mean = F.try_divide(F.sum(F.col("diff") * F.col("times")), F.sum(F.when(F.col("diff").isNotNull(), F.col("times"))))
    sets = d.groupingSets([["combo"], ["combo", "question_type"]], "combo", "question_type").agg(F.sum("times").alias("n"), mean.alias("mean_diff"))
    return sets.select("combo", F.coalesce("question_type", F.lit("all")).alias("scope"), "n", "mean_diff")


def without_common(means: DataFrame, baseline: str) -> DataFrame:
    """Items of the baseline's base that share no question with it."""
    common = paired_differences(means, baseline).select("combo").distinct()
    return _others(means, baseline, "left_semi").select("combo").distinct().join(common.hint("shuffle_hash"), "combo", "left_anti")


def _others(means: DataFrame, baseline: str, how: str) -> DataFrame:
    """Rows of the other items in the baseline's bases (``left_semi``) or outside them (``left_anti``)."""
    bases = means.where(F.col("combo") == baseline).select("base").distinct()
    return means.where(F.col("combo") != baseline).join(bases.hint("shuffle_hash"), "base", how)


def other_bases(means: DataFrame, baseline: str) -> DataFrame:
    """Items of other bases, never paired: questions and mean of each."""
    return _others(means, baseline, "left_anti").groupBy("combo").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))


def other_base_intervals(means: DataFrame, baseline: str, resamples: int = 10_000, seed: int = 0) -> DataFrame:
    """:func:`other_bases` with the interval of each mean."""
    values = _others(means, baseline, "left_anti").select("combo", F.col("value").alias("diff"))
    found = percentile_interval(bootstrap_means(values, "combo", resamples, seed), "combo", resamples)
    return other_bases(means, baseline).join(found.hint("merge"), "combo", "left").select("combo", "n", "mean", "low", "high")


def compare_intervals(means: DataFrame, baseline: str, resamples: int = 10_000, seed: int = 0) -> DataFrame:
    """:func:`compare` with the interval of each difference, in all and by question type."""
    means = written(means.select("combo", "base", "question", "question_type", "value"), "means")
    # Questions are paired once; what follows reads each difference with the number of its questions.
    d = written(paired_differences(means, baseline).groupBy("combo", "question_type", "diff").agg(F.count("*").alias("times")), "differences")
    values = d.select("combo", F.explode(F.array(F.lit("all"), "question_type")).alias("scope"), "diff", "times").select(F.struct("combo", "scope").alias("item"), "diff", "times")
    found = percentile_interval(bootstrap_means(values, "item", resamples, seed), "item", resamples).select("item.combo", "item.scope", "low", "high", "significant")
    return _compared(d).join(found.hint("merge"), ["combo", "scope"], "left")


#: Distinct values of a key in one task, and the rows of a distinct value from which counts are drawn, not places.
SHARD, PLAIN = 65_536, 12


def _drawn(rng: np.random.Generator, values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of ``sizes`` values each, drawn with replacement."""
    flat = values[rng.integers(0, len(values), int(sizes.sum()), dtype=np.uint32)]
    return np.bincount(np.repeat(np.arange(len(sizes)), sizes), flat, len(sizes)) if (sizes != sizes[0]).any() else flat.reshape(len(sizes), -1).sum(1)


def bootstrap_means(values: DataFrame, key: str, resamples: int = 10_000, seed: int = 0, block: int = 500, shard: int = SHARD) -> DataFrame:
    """(key, rep, mean): means of resamples with replacement of a key's values (column ``diff``), each of as many values.

    A row stands for ``times`` values where there is such a column.

    How often each distinct value is drawn is multinomial, so equal values are counted before any draw and a resample
    costs one binomial for each distinct value, however many rows it stands for. A key's distinct values are dealt to
    shards: the shards' totals are drawn first (every shard of a block draws the same ones, by the seed), then each
    shard's own counts. Blocks of resamples and shards are the unit of work, so no key is bound to one task.
    """
    times = F.sum("times") if "times" in values.columns else F.count("*")
    counted = values.where("diff is not null").groupBy(key, F.round("diff", 12).alias("diff")).agg(times.alias("c"))
    counted = written(counted, "counts")
    sizes = counted.groupBy(key).agg(F.ceil(F.count("*") / shard).alias("k"))
    dealt = counted.join(sizes.hint("merge"), key).groupBy(key, F.pmod(F.xxhash64("diff"), F.col("k")).alias("part"))
    parts = dealt.agg(F.sum("c").alias("m"), F.array_sort(F.collect_list(F.struct("diff", "c"))).alias("v"))
    totals = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("part", "m"))).alias("parts"))  # one entry for each shard
    firsts = F.explode(F.sequence(F.lit(0), F.lit(resamples - 1), F.lit(block))).alias("first")
    # The number is given, as adaptive execution would put these few small rows, each with much work, into one task.
    tasks = max(int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")), values.sparkSession.sparkContext.defaultParallelism)
    work = parts.join(totals.hint("merge"), key).select(key, "part", "v", "parts", firsts).repartition(4 * tasks, F.col(key), F.col("part"), F.col("first"))

    def run(keys: pd.Series, part: pd.Series, parts_: pd.Series, diffs: pd.Series, counts: pd.Series, firsts_: pd.Series) -> pd.Series:
        out = []
        for k, p, shards, v, c, first in zip(keys, part, parts_, diffs, counts, firsts_):
            reps, sizes_ = min(block, resamples - first), np.array([x["m"] for x in shards], dtype=np.int64)
            start = [seed, k % 2**63, first]
            drawn = np.random.default_rng(start).multinomial(sizes_.sum(), sizes_ / sizes_.sum(), reps)
            own = drawn[:, [x["part"] for x in shards].index(p)]
            rng, v, c = np.random.default_rng([*start, p + 1]), np.asarray(v, dtype=float), np.asarray(c)
            if c.sum() < PLAIN * len(c):  # few equal values: places cost less than counts
                each, rows = np.repeat(v, c), max(1, 500_000 // max(1, int(own.max())))
                sums = np.concatenate([_drawn(rng, each, own[at : at + rows]) for at in range(0, len(own), rows)])
            else:
                sums = rng.multinomial(own, c / c.sum()) @ v
            out.append(sums / sizes_.sum())
        return pd.Series(out)

    field = lambda name: F.transform("v", lambda x: x[name])
    sums = work.select(key, "first", F.pandas_udf(run, T.ArrayType(T.DoubleType()))(F.xxhash64(key), "part", "parts", field("diff"), field("c"), "first").alias("s"))
    flat = sums.select(key, "first", F.posexplode_outer("s").alias("i", "share"))  # plain posexplode would filter by size first, running the draws twice
    return flat.groupBy(key, (F.col("first") + F.col("i")).alias("rep")).agg(F.round(F.sum("share"), 9).alias("mean"))


def percentile_interval(draws: DataFrame, key: str, resamples: int) -> DataFrame:
    """Sorted draws at int(.025 R) and int(.975 R) - 1; significant if 0 lies outside. A key's R draws meet in one array."""
    lo, hi = int(0.025 * resamples), int(0.975 * resamples) - 1
    ordered = draws.groupBy(key).agg(F.sort_array(F.collect_list("mean")).alias("_v"))
    out = ordered.select(key, F.get("_v", F.lit(lo)).alias("low"), F.get("_v", F.lit(hi)).alias("high"))
    return out.withColumn("significant", (F.col("low") > 0) | (F.col("high") < 0))


def replay_interval(values: DataFrame, key: str, resamples: int = 10_000, seed: int = 0) -> DataFrame:
    """The interval with Python's seeded generator, one key in a task; for keys with few values."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        import random

        rng, x = random.Random(seed), group.sort_values("question")["diff"].to_numpy()
        draws = np.sort([x[[rng.randrange(len(x)) for _ in x]].mean() for _ in range(resamples)])
        return pd.DataFrame({key: [group[key].iloc[0]], "low": [draws[int(0.025 * resamples)]], "high": [draws[int(0.975 * resamples) - 1]]})

    return values.select(key, "question", "diff").groupBy(key).applyInPandas(run, f"{key} {values.schema[key].dataType.simpleString()}, low double, high double")


def average_ranks(rows: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """Mid-ranks within ``by``: rank plus half of the ties above one."""
    w = Window.partitionBy(*by)
    return rows.withColumn(name, F.rank().over(w.orderBy(value)) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2)


def chi2_tail(x: float, df: int) -> float:
    """Upper tail of chi-squared for a whole number of degrees of freedom, as a finite sum.

    Even: the probability of fewer than df/2 events of a Poisson law with mean x/2. Odd: erfc(sqrt(x/2)) and the terms
    (x/2)**(j - 1/2) exp(-x/2) / gamma(j + 1/2) for j = 1 .. (df - 1)/2.
    """
    if x <= 0:
        return 1.0
    half, odd = x / 2, df % 2
    powers = [j + odd / 2 for j in range(df // 2)]
    terms = [math.exp(a * math.log(half) - half - math.lgamma(a + 1)) for a in powers]
    return math.fsum(terms) + (math.erfc(math.sqrt(half)) if odd else 0.0)


def friedman(means: DataFrame, items: list[str]) -> DataFrame:
    """One row: complete questions, chi-squared over mid-ranks (no tie correction), degrees of freedom, p."""
    k = len(items)
    rows = means.where(F.col("combo").isin(*items))
    complete = rows.withColumn("c", F.count("*").over(Window.partitionBy("base", "question"))).where(F.col("c") == k)
    sums = average_ranks(complete, ["base", "question"], "value", "r").groupBy("combo").agg(F.sum("r").alias("s"), F.count("*").alias("n"))
    chi = 12.0 / (F.first("n") * k * (k + 1)) * F.sum(F.col("s") * F.col("s")) - 3.0 * F.first("n") * (k + 1)
    one = sums.agg(F.first("n").alias("questions"), chi.alias("chi2"), F.lit(k - 1).alias("df"))

    def tail(x: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(v) else chi2_tail(v, n) for v, n in zip(x, df)], dtype="float64")

    return one.withColumn("p", F.pandas_udf(tail, T.DoubleType())("chi2", "df"))

"""Human annotation: samples, notes, agreement and decisions. Notes are (item, annotator, dim, score)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def eligible(results: DataFrame, experiments: DataFrame | None = None) -> DataFrame:
    """Scored answers without an error, of finished experiments (experiment, status) if these are given."""
    scored = results.where(F.col("chrf").isNotNull() & ~F.col("answer").startswith("[ERRO: "))
    if experiments is None:
        return scored
    return scored.join(experiments.where("status = 'done'").select("experiment").hint("merge"), "experiment", "left_semi")


def pool_violations(chosen: DataFrame, experiments: DataFrame) -> DataFrame:
    """(round, error) of rounds (round, experiment) whose experiments (experiment, status, base) can't be sampled together."""
    rows = chosen.join(experiments.hint("merge"), "experiment", "left")
    by = rows.groupBy("round").agg(F.count_if(F.coalesce(F.col("status") != "done", F.lit(True))).alias("open"), F.countDistinct("base").alias("bases"))
    error = F.when(F.col("open") > 0, "unfinished experiments").when(F.col("bases") > 1, "experiments of several bases")
    return by.select("round", error.alias("error")).where("error is not null")


def allocate(pool: DataFrame, stratum: str, size: int, allocation: str = "equal") -> DataFrame:
    """(stratum, available, target, allocated, short): ``equal`` shares, or ``proportional`` ones by largest remainder.

    A stratum with fewer rows than its target gives the rest to the others, one at a time in the order of the names:
    round k reaches every stratum with more than k rows to spare. Works on one row for each stratum.
    """
    n = pool.groupBy(stratum).agg(F.count("*").alias("available"))
    all_, order = Window.partitionBy(), Window.orderBy(stratum)
    i = F.row_number().over(order)
    if allocation == "equal":
        count = F.count("*").over(all_)
        target = F.floor(F.lit(size) / count) + (i <= F.pmod(F.lit(size), count)).cast("int")
        rows = n.withColumn("target", target.cast("long"))
    else:
        exact = F.col("available") * size / F.sum("available").over(all_)
        rows = n.withColumn("_e", exact).withColumn("_f", F.floor("_e").cast("long"))
        left = F.lit(size) - F.sum("_f").over(all_)
        rows = rows.withColumn("target", F.col("_f") + (F.row_number().over(Window.orderBy(F.desc(F.round(F.col("_e") - F.col("_f"), 9)), stratum)) <= left).cast("int")).drop("_e", "_f")
    rows = rows.withColumn("_a", F.least("target", "available")).withColumn("_spare", F.col("available") - F.col("_a"))
    rows = rows.withColumn("_need", F.least(F.lit(size) - F.sum("_a").over(all_), F.sum("_spare").over(all_)))
    # One more row at a time: the k-th extra row of a stratum comes after all (k-1)-th ones, by name.
    extra = rows.withColumn("_k", F.explode(F.when((F.col("_spare") > 0) & (F.col("_need") > 0), F.sequence(F.lit(1), F.least("_spare", "_need").cast("int"))).otherwise(F.array(F.lit(0)))))
    turn = F.row_number().over(Window.orderBy((F.col("_k") == 0), "_k", stratum))
    extra = extra.withColumn("_given", ((F.col("_k") > 0) & (turn <= F.col("_need"))).cast("int"))
    out = extra.groupBy(stratum, "available", "target", "_a").agg(F.sum("_given").alias("_g"))
    return out.select(stratum, "available", "target", (F.col("_a") + F.col("_g")).alias("allocated"), (F.col("available") < F.col("target")).alias("short"))


def _hash(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", *(p.cast("string") for p in parts)).cast("binary"))


def sample(pool: DataFrame, stratum: str, key: str, plan: DataFrame, seed: int) -> DataFrame:
    """The allocated number of each stratum in the order of a seeded hash, at positions by another hash."""
    place = F.row_number().over(Window.partitionBy(stratum).orderBy(_hash(F.lit(seed), F.col(key)), key))
    chosen = pool.withColumn("_n", place).join(F.broadcast(plan.select(stratum, "allocated")), stratum).where(F.col("_n") <= F.col("allocated"))
    return chosen.select(*pool.columns, F.row_number().over(Window.orderBy(_hash(F.lit(seed), F.lit("p"), F.col(key)), key, stratum)).alias("position"))


def annotator_order(items: DataFrame, annotators: DataFrame, seed: int) -> DataFrame:
    """(annotator, item, place): each annotator's own stable order; ``annotators`` is a short list."""
    pairs = items.select("item").crossJoin(F.broadcast(annotators.select("annotator")))
    return pairs.withColumn("place", F.row_number().over(Window.partitionBy("annotator").orderBy(_hash(F.lit(seed), F.col("annotator"), F.col("item")), "item")))


def queue(order: DataFrame, notes: DataFrame) -> DataFrame:
    """An annotator's items with their own notes; nothing of where an answer comes from."""
    mine = notes.groupBy("item", "annotator").agg(F.max(F.col("score").isNotNull()).alias("done"))
    return order.join(mine, ["item", "annotator"], "left").select("annotator", "item", "place", F.coalesce("done", F.lit(False)).alias("done"))


def progress(order: DataFrame, notes: DataFrame) -> DataFrame:
    """Done and total by annotator; those who scored without taking part are listed too."""
    q = queue(order, notes).groupBy("annotator").agg(F.count_if("done").alias("done"), F.count("*").alias("total"))
    extra = notes.where("score is not null").groupBy("annotator").agg(F.countDistinct("item").alias("scored"))
    return q.join(extra, "annotator", "full").select("annotator", F.coalesce("done", "scored").alias("done"), F.coalesce("total", F.lit(0)).alias("total"))


def note_violation(context: Column, correctness: Column, grounding: Column, cannot: Column, reason: Column) -> Column:
    """Why a note is refused; null if it is fine. ``context``: the item has retrieved passages."""
    empty = F.coalesce(F.btrim(reason) == "", F.lit(True))
    any_score = correctness.isNotNull() | grounding.isNotNull()
    return (
        F.when(cannot & empty, "reason missing").when(cannot & any_score, "scores with cannot evaluate").when(cannot, F.lit(None))
        .when(correctness.isNull(), "correctness missing").when(context & grounding.isNull(), "grounding missing").when(~context & grounding.isNotNull(), "grounding without passages")
    )


def pair_violation(preference: Column, reasons: Column, cannot: Column, reason: Column, known: list[str]) -> Column:
    empty = F.coalesce(F.btrim(reason) == "", F.lit(True))
    n = F.coalesce(F.size(reasons), F.lit(0))
    return (
        F.when(cannot & empty, "reason missing").when(cannot & (preference.isNotNull() | (n > 0)), "preference with cannot evaluate").when(cannot, F.lit(None))
        .when(preference.isNull() | ~preference.isin("A", "tie", "B"), "preference missing").when((preference == "tie") & (n > 0), "reasons for a tie")
        .when((preference != "tie") & (n == 0), "reasons missing").when(F.size(F.array_except(reasons, F.array(*map(F.lit, known)))) > 0, "unknown reasons")
    )


def latest(log: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """The last note of each (item, annotator, dim); notes of removed annotators don't count."""
    last = F.row_number().over(Window.partitionBy("item", "annotator", "dim").orderBy(F.desc("updated_at"), F.desc("note_id")))
    rows = log.withColumn("_n", last).where("_n = 1").drop("_n")
    return rows.join(removed, "annotator", "left_anti") if removed is not None else rows


def krippendorff(notes: DataFrame, by: list[str], level: str = "ordinal") -> DataFrame:
    """Alpha by ``by``; null without pairable units or variation.

    Every difference is one of places on a line (an ordinal value's place is its cumulated frequency, less half its own), squared, or
    whether two values differ. Sums over pairs then follow from each unit's sums over its values, so no pair is ever made: the cost grows with the notes.
    """
    counts = notes.where("score is not null").groupBy(*by, "item", "score").agg(F.count("*").alias("c"))
    counts = counts.withColumn("m", F.sum("c").over(Window.partitionBy(*by, "item"))).where("m > 1")
    freq = counts.groupBy(*by, "score").agg(F.sum("c").cast("double").alias("f"))
    whole = Window.partitionBy(*by)
    if level == "ordinal":
        freq = freq.withColumn("x", F.sum("f").over(whole.orderBy("score")) - F.col("f") / 2)
    else:
        freq = freq.withColumn("x", F.col("score").cast("double"))
    freq = freq.withColumn("n", F.sum("f").over(whole)).withColumn("x", F.col("x") - F.sum(F.col("f") * F.col("x")).over(whole) / F.col("n"))
    c, x = F.col("c"), F.col("x")
    if level == "nominal":
        in_unit, apart = (F.first("m") * F.first("m") - F.sum(c * c)) / (F.first("m") - 1), F.first("n") * F.first("n") - F.sum(F.col("f") * F.col("f"))
    else:
        in_unit = 2 * (F.first("m") * F.sum(c * x * x) - F.sum(c * x) * F.sum(c * x)) / (F.first("m") - 1)
        apart = 2 * F.first("n") * F.sum(F.col("f") * x * x)  # places are centred
    found = counts.join(freq.select(*by, "score", "x"), [*by, "score"]).groupBy(*by, "item").agg(in_unit.alias("w")).groupBy(*by).agg(F.sum("w").alias("o"))
    chance = freq.groupBy(*by).agg((apart / (F.first("n") - 1)).alias("e"))
    return found.join(chance, by).select(*by, F.when(F.col("e") > 0, 1 - F.col("o") / F.col("e")).alias("alpha"))


def confusion(pairs: DataFrame, by: list[str]) -> DataFrame:
    """(x, y, n) by ``by`` for two raters' scores x and y."""
    return pairs.where("x is not null and y is not null").groupBy(*by, "x", "y").agg(F.count("*").alias("n"))


def kappa(pairs: DataFrame, by: list[str], weights: str = "none") -> DataFrame:
    """Cohen's kappa, unweighted, ``linear`` or ``quadratic``; null when no disagreement is expected."""
    c = confusion(pairs, by)
    px, py = c.groupBy(*by, "x").agg(F.sum("n").alias("nx")), c.groupBy(*by, "y").agg(F.sum("n").alias("ny"))
    total = c.groupBy(*by).agg(F.sum("n").alias("t"))
    grid = px.join(py, by).join(total, by).join(c, [*by, "x", "y"], "left")
    gap = F.abs(F.col("x") - F.col("y"))
    w = {"none": (gap > 0).cast("double"), "linear": gap.cast("double"), "quadratic": F.pow(gap, 2)}[weights]
    s = grid.groupBy(*by).agg(F.sum(w * F.coalesce("n", F.lit(0)) / F.col("t")).alias("o"), F.sum(w * F.col("nx") * F.col("ny") / F.col("t") / F.col("t")).alias("e"))
    return s.select(*by, F.when(F.col("e") > 0, 1 - F.col("o") / F.col("e")).alias("kappa"))


def bootstrap_kappa(pairs: DataFrame, by: list[str] | None = None, weights: str = "none", resamples: int = 10_000, seed: int = 0) -> DataFrame:
    """(low, high) by ``by``: kappa over resamples of the units with replacement; undefined resamples are skipped.

    Units of equal scores are alike, so a resample is a multinomial draw over the cells of the confusion table: the
    units are counted on the executors, and only the cells (scores by scores) of a group meet in one place. Bounds are
    the sorted values at int(.025 n) and min(n - 1, int(.975 n)).
    """
    by = by or []
    cells = confusion(pairs, by).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("x", "y", "n"))).alias("cells"))

    def bounds(groups: pd.Series) -> pd.DataFrame:
        out = []
        for group in groups:
            x, y, n = (np.array([c[k] for c in group], dtype=float) for k in ("x", "y", "n"))
            values, gap = np.union1d(x, y), lambda a, b: {"none": (a != b) * 1.0, "linear": abs(a - b), "quadratic": (a - b) ** 2}[weights]
            share = np.random.default_rng(seed).multinomial(int(n.sum()), n / n.sum(), resamples) / n.sum()
            rows, columns = share @ (x[:, None] == values), share @ (y[:, None] == values)
            expected = ((rows @ gap(values[:, None], values)) * columns).sum(1)
            observed = share @ gap(x, y)
            k = np.sort(1 - observed[expected > 0] / expected[expected > 0])
            out.append((k[int(0.025 * len(k))], k[min(len(k) - 1, int(0.975 * len(k)))]) if len(k) else (None, None))
        return pd.DataFrame(out, columns=["low", "high"], dtype=float)

    return cells.select(*by, F.pandas_udf(bounds, "low double, high double")("cells").alias("b")).select(*by, "b.low", "b.high")


def final_notes(notes: DataFrame, decisions: DataFrame, items: DataFrame) -> DataFrame:
    """(item, dim, final) and the item's status: what all agree on, the adjudicator's score where they don't."""
    v = notes.where("score is not null").groupBy("item", "dim").agg(F.countDistinct("score").alias("k"), F.count("*").alias("n"), F.min("score").alias("common"))
    d = decisions.select("item", "dim", F.col("score").alias("decided"))
    x = v.join(d, ["item", "dim"], "left").withColumn("final", F.when(F.col("k") > 1, F.col("decided")).otherwise(F.col("common")))
    decided = decisions.select("item").distinct().withColumn("has", F.lit(True))
    state = x.groupBy("item").agg(F.max("k").alias("k"), F.max("n").alias("n")).join(decided, "item", "left")
    status = F.when((F.col("k") > 1) & F.col("has").isNull(), "pendente").when(F.col("k") > 1, "adjudicada").when(F.col("n") >= 2, "concordância").when(F.col("n") == 1, "uma nota").otherwise("sem notas")
    state = items.select("item").join(state, "item", "left").select("item", status.alias("status"))
    return state.join(x.select("item", "dim", "final"), "item", "left")


def adjudication_violation(decision: DataFrame, rounds: DataFrame, notes: DataFrame) -> DataFrame:
    """Decisions (decision, round, item, adjudicator, correctness, grounding) with the first reason to refuse each; null if it stands.

    ``rounds`` (round, adjudicator, status), ``notes`` (round, item, annotator, dim, score). Only the designated
    adjudicator decides, once the round is closed, never one who scored in it, only where scores differ, and on
    every dimension where they do.
    """
    scored = notes.where("score is not null")
    named = rounds.select("round", F.col("adjudicator").alias("designated"), "status")
    own = scored.select("round", F.col("annotator").alias("adjudicator")).distinct().withColumn("took_part", F.lit(True))
    dims = scored.groupBy("round", "item", "dim").agg(F.countDistinct("score").alias("k")).where("k > 1")
    disputed = dims.groupBy("round", "item").agg(F.array_sort(F.collect_list("dim")).alias("disputed"))
    rows = decision.join(named.hint("merge"), "round", "left").join(own.hint("merge"), ["round", "adjudicator"], "left").join(disputed.hint("merge"), ["round", "item"], "left")
    given = F.map_from_arrays(F.array(F.lit("correctness"), F.lit("grounding")), F.array("correctness", "grounding"))
    missing = F.filter("disputed", lambda d: given[d].isNull())
    reason = (
        F.when(~F.col("designated").eqNullSafe(F.col("adjudicator")), "not the adjudicator").when(F.coalesce(F.col("status") != "closed", F.lit(True)), "round not closed")
        .when(F.col("took_part"), "adjudicator scored in the round").when(F.col("disputed").isNull(), "nothing disputed")
        .when(F.size(missing) > 0, F.concat(F.lit("undecided: "), F.array_join(missing, ", ")))
    )
    return rows.withColumn("violation", reason).select(*decision.columns, "disputed", "violation")


def decided(checked: DataFrame) -> DataFrame:
    """(round, item, dim, score): of the decisions that stand the last one counts, for the disputed dimensions alone."""
    last = F.row_number().over(Window.partitionBy("round", "item").orderBy(F.desc("decision")))
    kept = checked.where("violation is null").withColumn("n", last).where("n = 1")
    pairs = F.array(*(F.struct(F.lit(d).alias("dim"), F.col(d).alias("score")) for d in ("correctness", "grounding")))
    return kept.select("round", "item", F.explode(F.filter(pairs, lambda p: F.array_contains("disputed", p["dim"]))).alias("p")).select("round", "item", "p.*")


def spearman_interval(pairs: DataFrame, by: list[str], x: str, y: str, resamples: int = 2000, seed: int = 0) -> DataFrame:
    """(low, high) by ``by`` of the rank correlation over resamples of the pairs; undefined resamples are skipped.

    Equal pairs are counted first, and a resample is a multinomial draw of their counts, from which mid-ranks follow by
    running sums. A group's distinct pairs meet in one task: a round is a sample that people have scored.
    """
    counted = pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).agg(F.count("*").alias("n"))

    def ranks(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
        _, at = np.unique(values, return_inverse=True)
        sums = np.zeros((len(counts), at.max() + 1))
        np.add.at(sums.T, at, counts.T)
        return (np.cumsum(sums, axis=1) - sums / 2)[:, at]

    def run(groups: pd.Series) -> pd.DataFrame:
        out = []
        for group in groups:
            a, b, n = (np.array([g[k] for g in group], dtype=float) for k in ("x", "y", "n"))
            rng, found = np.random.default_rng(seed), []
            for _ in range(0, resamples, 250):
                c = rng.multinomial(int(n.sum()), n / n.sum(), 250)
                p, q = ranks(a, c), ranks(b, c)
                total = c.sum(1, keepdims=True)
                p, q = p - (c * p).sum(1, keepdims=True) / total, q - (c * q).sum(1, keepdims=True) / total
                size = np.sqrt((c * p * p).sum(1) * (c * q * q).sum(1))
                found.append(((c * p * q).sum(1)[size > 0]) / size[size > 0])
            r = np.sort(np.concatenate(found))
            out.append((r[int(0.025 * len(r))], r[min(len(r) - 1, int(0.975 * len(r)))]) if len(r) else (None, None))
        return pd.DataFrame(out, columns=["low", "high"], dtype=float)

    grouped = counted.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("x", "y", "n"))).alias("_pairs"))
    return grouped.select(*by, F.pandas_udf(run, "low double, high double")("_pairs").alias("_b")).select(*by, "_b.low", "_b.high")


def group_means(rows: DataFrame, by: list[str]) -> DataFrame:
    """Mean human and automatic score by group over the same rows: those that have both."""
    both = rows.where("human is not null and automatic is not null")
    return both.groupBy(*by).agg(F.count("*").alias("n"), F.avg("human").alias("human"), F.avg("automatic").alias("automatic"))


def retest(items: DataFrame, annotator: str, seed: int) -> DataFrame:
    """A round's items (item, position) copied for one annotator's second pass: (source_item, annotator, position) in an order of its own."""
    order = F.row_number().over(Window.orderBy(_hash(F.lit(seed), F.lit(annotator), F.col("item")), "item"))
    return items.select(F.col("item").alias("source_item"), F.lit(annotator).alias("annotator"), order.alias("position"))


def two_passes(first: DataFrame, second: DataFrame, annotator: str) -> DataFrame:
    """Notes (item, annotator, dim, score) of one annotator's pass over a round and over its retest, as those of two raters."""
    one = first.where(F.col("annotator") == annotator).withColumn("annotator", F.lit("first"))
    two = second.where(F.col("annotator") == annotator).withColumn("annotator", F.lit("second"))
    return one.select("item", "annotator", "dim", "score").unionByName(two.select("item", "annotator", "dim", "score"))


def preference_scores(notes: DataFrame) -> DataFrame:
    """Pairwise notes (item, annotator, preference, cannot) as scores on the scale A < tie < B; what can't be judged is missing."""
    place = F.when(F.col("preference") == "A", 0).when(F.col("preference") == "tie", 1).when(F.col("preference") == "B", 2)
    return notes.select("item", "annotator", F.lit("preference").alias("dim"), F.when(~F.coalesce("cannot", F.lit(False)), place).alias("score"))


def pair_round(results: DataFrame, a: str, b: str, seed: int) -> DataFrame:
    """Common questions of two combinations (last result of each), with the side shown first drawn by a hash."""
    last = results.where(F.col("combo").isin(a, b)).groupBy("combo", "question").agg(F.max("result_id").alias("r"))
    x, y = last.where(F.col("combo") == a).select("question", F.col("r").alias("result_1")), last.where(F.col("combo") == b).select("question", F.col("r").alias("result_2"))
    side = F.substring(_hash(F.lit(seed), F.col("question")), 1, 1)
    return x.join(y, "question").withColumn("a_is_1", side < "8")


def unblind(notes: DataFrame) -> DataFrame:
    """Preference for side 1, 2 or a tie, whatever was shown first."""
    first = F.when(F.col("preference") == "tie", "tie").when((F.col("preference") == "A") == F.col("a_is_1"), "1").otherwise("2")
    return notes.withColumn("winner", F.when(F.col("preference").isNotNull(), first))


def fair_tail(n: int, k: int) -> float:
    """The probability of at most k heads in n throws of a fair coin: the regularised incomplete beta function at 1/2.

    I(a, b) with a = n - k and b = k + 1 is a power times a continued fraction, here by its convergents; beyond the middle it is one less the other tail.
    """
    if k < 0 or k >= n:
        return float(k >= n)
    if 2 * k >= n:
        return 1.0 - fair_tail(n, n - k - 1)
    a, b = n - k, k + 1
    front = math.exp(math.lgamma(n + 1) - math.lgamma(a + 1) - math.lgamma(b) - n * math.log(2) - math.log(2))
    # Numerators of the fraction, taken in pairs; h and d are rescaled so that they stay near 1.
    c, d = 1.0, 1 / (1 - (a + b) * 0.5 / (a + 1))
    value, j = d, 1
    while True:
        for term in (j * (b - j) * 0.5 / ((a + 2 * j - 1) * (a + 2 * j)), -(a + j) * (a + b + j) * 0.5 / ((a + 2 * j) * (a + 2 * j + 1))):
            d, c = 1 / (1 + term * d), 1 + term / c
            value *= c * d
        if abs(c * d - 1) < 1e-15 or j > n:
            return front * value
        j += 1


def pair_summary(notes: DataFrame, z: float = 1.959963984540054) -> DataFrame:
    """By annotator and in all (annotator null): wins, ties, two-sided sign test and Wilson interval of side 1's share; one row each in all steps."""
    count = lambda v: F.count_if(F.col("winner") == v)
    s = notes.where("winner is not null").groupingSets([["annotator"], []], "annotator").agg(count("1").alias("wins_1"), count("2").alias("wins_2"), count("tie").alias("ties"))

    def tails(n: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([min(1.0, 2 * fair_tail(int(a), int(b))) if a > 0 else None for a, b in zip(n, k, strict=True)], dtype="float64")

    s = s.withColumn("n", F.col("wins_1") + F.col("wins_2")).withColumn("p", F.pandas_udf(tails, "double")("n", F.least("wins_1", "wins_2")))
    share, n = F.col("wins_1") / F.col("n"), F.col("n")
    centre, spread, denom = share + z * z / (2 * n), z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n)), 1 + z * z / n
    ok = F.col("n") > 0
    return s.select("annotator", "wins_1", "wins_2", "ties", "p", F.when(ok, (centre - spread) / denom).alias("low"), F.when(ok, (centre + spread) / denom).alias("high"))


def reason_counts(notes: DataFrame) -> DataFrame:
    return notes.where("winner <> 'tie'").select("winner", F.explode("reasons").alias("reason")).groupBy("winner", "reason").agg(F.count("*").alias("n"))


def duplicate_names(annotators: DataFrame) -> DataFrame:
    """Names that more than one annotator has, letter case aside."""
    return annotators.groupBy(F.lower("name").alias("name")).agg(F.count("*").alias("n")).where("n > 1")


def removable_rounds(rounds: DataFrame, notes: DataFrame) -> DataFrame:
    """Rounds without notes and without a retest."""
    retests = rounds.where("source_round is not null").select(F.col("source_round").alias("round"))
    return rounds.join(notes.select("round").distinct(), "round", "left_anti").join(retests, "round", "left_anti")

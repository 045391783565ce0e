"""Answer and retrieval metrics, one row for each sample."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragbench.functions.similarity import partial_ratio, token_lcs
from ragbench.functions.text import fold, normal_words, one_space, pt_tokens, words
from ragbench.functions.vectors import cosine, embed_distinct

MATCH_RATIO, LENGTH_SHARE = 80, 0.5


def found_in(evidence: Column, chunk: Column, fuzzy: bool = True) -> Column:
    """Whether a chunk holds the evidence: by containment of the normalised text, or by partial ratio.

    False for an empty target and for a chunk shorter than half of it. The ratio is only worked out for rows that
    containment leaves open.
    """
    target, text = normal_words(evidence), normal_words(chunk)
    possible = (target != "") & (F.length(text) >= LENGTH_SHARE * F.length(target))
    inside = F.contains(text, target)
    if not fuzzy:
        return F.coalesce(possible & inside, F.lit(False))
    ratio = partial_ratio(F.when(possible & ~inside, target), F.when(possible & ~inside, text), MATCH_RATIO)
    return F.coalesce(possible & (inside | (ratio >= MATCH_RATIO)), F.lit(False))


def evidence_matches(evidence: DataFrame, contexts: DataFrame, fuzzy: bool = True) -> DataFrame:
    """Evidence (qid, passage_no, hop, passage) with the retrieved chunks (qid, rank, text) of its question: adds ``found``."""
    return evidence.hint("merge").join(contexts, "qid", "left").withColumn("found", found_in(F.col("passage"), F.col("text"), fuzzy))


def index_sizes(chunks: DataFrame, by: list[str]) -> DataFrame:
    """By index: number of chunks, mean and greatest number of characters."""
    return chunks.groupBy(*by).agg(F.count("*").alias("chunks"), F.avg(F.length("text")).alias("mean_chars"), F.max(F.length("text")).alias("longest"))


def gold_metrics(matches: DataFrame) -> DataFrame:
    """context_hit, context_mrr, context_recall_gold and context_all_hops by question."""
    hop = matches.groupBy("qid", "hop").agg(F.bool_or("found").alias("h")).groupBy("qid").agg(F.bool_and("h").cast("double").alias("context_all_hops"))
    passage = matches.groupBy("qid", "passage_no").agg(F.bool_or("found").cast("double").alias("p")).groupBy("qid").agg(F.avg("p").alias("context_recall_gold"))
    rank = matches.groupBy("qid").agg(
        F.max(F.col("found").cast("double")).alias("context_hit"), F.coalesce(1 / F.min(F.when(F.col("found"), F.col("rank"))), F.lit(0.0)).alias("context_mrr")
    )
    return rank.join(passage, "qid").join(hop, "qid")


def _f1(shared: Column, a: Column, b: Column) -> Column:
    return F.when(shared == 0, 0.0).otherwise(2 * (shared / a) * (shared / b) / (shared / a + shared / b))


def rouge_l(samples: DataFrame) -> DataFrame:
    """LCS F1 of lower-case tokens; samples have id, answer, reference. A missing reference gives no row."""
    t = samples.where("reference is not null and answer is not null").select("id", words(F.col("answer")).alias("a"), words(F.col("reference")).alias("r"))
    lcs = t.select("id", F.size("a").alias("n"), F.size("r").alias("m"), token_lcs(F.col("a"), F.col("r")).alias("k"))
    return lcs.select("id", _f1(F.col("k"), F.col("n"), F.col("m")).alias("rouge_l"))


def _shared(items: DataFrame) -> DataFrame:
    """(key, n_a, n_r, shared) from (key, x, side): multiset counts of both sides and of what they share, in one shuffle."""
    n = items.groupBy("key", "x").agg(F.count_if(F.col("side") == "a").alias("ca"), F.count_if(F.col("side") == "r").alias("cr"))
    return n.groupBy("key").agg(F.sum("ca").alias("n_a"), F.sum("cr").alias("n_r"), F.sum(F.least("ca", "cr")).alias("shared"))


def token_f1(samples: DataFrame) -> DataFrame:
    """Multiset F1 of normalised tokens."""
    base = samples.where("reference is not null and answer is not null")
    sides = [base.select(F.col("id").alias("key"), F.explode(pt_tokens(F.col(c))).alias("x"), F.lit(side).alias("side")) for c, side in (("answer", "a"), ("reference", "r"))]
    score = _f1(F.col("shared"), F.col("n_a"), F.col("n_r"))
    found = _shared(sides[0].unionByName(sides[1])).select(F.col("key").alias("id"), score.alias("token_f1"))
    return base.select("id").join(found.hint("merge"), "id", "left").withColumn("token_f1", F.coalesce("token_f1", F.lit(0.0)))


def _grams(text: str, order: int) -> list[Counter]:
    return [Counter(text[i : i + n] for i in range(len(text) - n + 1)) for n in range(1, order + 1)]


def _chrf(a: str, r: str, order: int, beta: float) -> float:
    shares = [((x & y).total() / x.total(), (x & y).total() / y.total()) for x, y in zip(_grams(a, order), _grams(r, order)) if x and y]
    if not shares:
        return 0.0
    p, q = (sum(column) / len(shares) for column in zip(*shares))
    return (1 + beta * beta) * p * q / (beta * beta * p + q) if p + q else 0.0


def chrf(samples: DataFrame, order: int = 6, beta: float = 2.0) -> DataFrame:
    """Character n-gram F score (orders 1 to 6, white space removed): precision and recall averaged over orders that both texts have.

    A sample's score needs its own two texts only, so it is worked out where the row is, in Arrow batches: n-grams are
    counted there and never shuffled.
    """
    def run(answers: pd.Series, references: pd.Series) -> pd.Series:
        return pd.Series([_chrf(a, r, order, beta) for a, r in zip(answers, references)], dtype=float)

    bare = lambda c: F.regexp_replace(c, r"(?U)\s+", "")
    base = samples.where("reference is not null and answer is not null")
    return base.select("id", F.pandas_udf(run, T.DoubleType())(bare("answer"), bare("reference")).alias("chrf"))


def embedding_metrics(samples: DataFrame, known: DataFrame | None = None, embed=None) -> DataFrame:
    """answer_relevancy, faithfulness, context_precision, context_recall, answer_correctness; samples have id, question, answer, reference, contexts.

    Each distinct text is embedded once. A metric whose inputs are missing is null; the runner leaves it out.
    """
    joined = samples.withColumn("joined", F.array_join("contexts", " "))
    texts = joined.select(F.explode(F.concat(F.array("question", "answer", "reference", "joined"), F.coalesce("contexts", F.array().cast("array<string>")))).alias("text"))
    vectors = embed_distinct(texts, "text", known, embed) if embed else embed_distinct(texts, "text", known)

    keyed = vectors.select(F.md5("text").alias("key"), "vector")  # joins go by a hash, so that texts are not sorted

    def with_vector(rows: DataFrame, column: str, name: str) -> DataFrame:
        found = keyed.select(F.col("key").alias(f"{name}_key"), F.col("vector").alias(name))
        return rows.join(found.hint("merge"), F.md5(column) == found[f"{name}_key"], "left").drop(f"{name}_key")

    rows = joined
    for column, name in (("question", "vq"), ("answer", "va"), ("reference", "vr"), ("joined", "vj")):
        rows = with_vector(rows, column, name)
    positive = lambda x: F.greatest(F.lit(0.0), x)
    each = with_vector(rows.select("id", "vq", F.explode("contexts").alias("context")), "context", "vc")
    precision = each.groupBy("id").agg(F.avg(positive(cosine(F.col("vq"), F.col("vc")))).alias("context_precision"))
    has = F.size("contexts") > 0
    out = rows.select(
        "id", positive(cosine(F.col("va"), F.col("vq"))).alias("answer_relevancy"), F.when(has, positive(cosine(F.col("va"), F.col("vj")))).alias("faithfulness"),
        F.when(has, positive(cosine(F.col("vr"), F.col("vj")))).alias("context_recall"), positive(cosine(F.col("va"), F.col("vr"))).alias("answer_correctness"),
    )
    return out.join(precision.hint("merge"), "id", "left")


def as_scores(metrics: DataFrame, names: list[str]) -> DataFrame:
    """(id, metric, value) in long form: metrics that do not apply are absent, not 0."""
    pairs = F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names))
    return metrics.select("id", F.explode(pairs).alias("m")).select("id", "m.metric", "m.value").where("value is not null")


def pending(results: DataFrame, scores: DataFrame, metrics: list[str]) -> DataFrame:
    """(id, metric) pairs still to be scored: of answers without an error, those that ``scores`` lacks."""
    wanted = results.where(~F.col("answer").startswith("[ERRO: ")).select("id", F.explode(F.array(*map(F.lit, metrics))).alias("metric"))
    return wanted.join(scores.select("id", "metric").hint("merge"), ["id", "metric"], "left_anti")


#: Units of measured facts and how an answer may spell them; marks, thousands' dots and numbers as written in Portuguese.
UNITS = {"m²": "m²|m2|metros quadrados", "m": "m|metros?", "km": "km|quil[oô]metros?", "h": r"h|:\d\d", "pessoas": "pessoas", "habitantes": "habitantes"}
ORDINALS, THOUSANDS, NUMBER = "[ºª]", r"(?<=\d)\.(?=\d{3}\b)", r"\d+(?:,\d+)?"
_MEASURE = rf"({NUMBER})\s*({'|'.join(UNITS.values())})(?![\p{{L}}\d²])"


def _bare(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), ORDINALS, ""), THOUSANDS, "")


def _number(x: Column) -> Column:
    return F.regexp_replace(x, r"^0+(?=\d)", "")


def measures(text: Column) -> Column:
    """What a text measures: an array of (number, unit, spelled), the unit by its name in UNITS."""
    bare = _bare(text)
    found = F.arrays_zip(F.regexp_extract_all(bare, F.lit(_MEASURE), F.lit(1)).alias("number"), F.regexp_extract_all(bare, F.lit(_MEASURE), F.lit(2)).alias("spelled"))

    def unit(spelled: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, spellings in UNITS.items():
            out = F.when(spelled.rlike(f"^(?:{spellings})$"), name).otherwise(out)
        return out

    return F.transform(found, lambda x: F.struct(_number(x["number"]).alias("number"), unit(x["spelled"]).alias("unit"), x["spelled"].alias("spelled")))


def key_facts(facts: DataFrame, ratio: float = 85) -> DataFrame:
    """Facts (id, fact, answer) found in an answer.

    Fact and answer are read by one tokeniser into numbers and measures. A fact that measures something by a unit's symbol needs the same
    measures in the answer, however that spells the unit; one with other numbers needs those numbers; one without numbers is compared by
    partial ratio, accents and case aside. Dots of thousands, leading zeros and ordinal marks don't count; a comma makes decimals.
    """
    fact, answer = F.col("fact"), F.col("answer")
    pair = lambda x: F.concat_ws(" ", x["number"], x["unit"])
    wanted = F.transform(F.filter(measures(fact), lambda x: x["spelled"] == x["unit"]), pair)
    numbers = lambda text: F.transform(F.regexp_extract_all(_bare(text), F.lit(f"({NUMBER})"), F.lit(1)), _number)
    within = lambda some, all_: F.size(F.array_except(some, all_)) == 0
    words = [one_space(fold(F.when(~fact.rlike(r"\d"), text))) for text in (fact, answer)]
    found = F.when(F.size(wanted) > 0, within(wanted, F.transform(measures(answer), pair))).when(fact.rlike(r"\d"), within(numbers(fact), numbers(answer))).otherwise(partial_ratio(*words) >= ratio)
    return facts.select("id", "fact", F.coalesce(found, F.lit(False)).alias("found"))


def leakage_class(found: DataFrame) -> DataFrame:
    """all, half or none of the key facts by id (``half``: at least half)."""
    n = found.groupBy("id").agg(F.count("*").alias("facts"), F.count_if("found").alias("hits"))
    return n.withColumn("leak", F.when(F.col("hits") == F.col("facts"), "all").when(2 * F.col("hits") >= F.col("facts"), "half").otherwise("none"))

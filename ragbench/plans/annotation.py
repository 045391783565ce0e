"""Queries on annotation, grids and dialogues."""

from __future__ import annotations

from pyspark.sql import functions as F

from ragbench.operators import annotation as an
from ragbench.operators import dialogue as dl
from ragbench.operators import grid as gr
from ragbench.plans import frames as f
from ragbench.plans.ranking import r6

QUERIES, SQL = {}, {}


def add(name, fn, sql=None):
    QUERIES[name] = fn
    if sql:
        SQL[name] = sql


def notes(s, d):
    """Three raters of two dimensions: quality, toxicity and the length class of a document; some are missing."""
    x = f.table(s, d, "labels").join(f.table(s, d, "documents").select("doc_id", "n_chars", "lang", "source"), "doc_id")
    third = F.when(F.col("n_chars") % 7 == 0, None).otherwise((F.col("n_chars") % 3).cast("int"))
    raters = F.array(*(F.struct(F.lit(a).alias("annotator"), F.lit(m).alias("dim"), c.cast("int").alias("score")) for a, m, c in (
        ("ana", "correctness", F.col("quality")), ("bia", "correctness", F.col("quality") + F.col("toxic")), ("caio", "correctness", third),
        ("ana", "grounding", F.col("toxic")), ("bia", "grounding", F.when(F.col("n_chars") % 5 > 0, F.col("toxic"))))))
    return x.select(F.col("doc_id").alias("item"), F.explode(raters).alias("r")).select("item", "r.*")


_N = """x AS (SELECT l.doc_id AS item, quality, toxic, n_chars FROM labels l JOIN documents d USING (doc_id)),
nt AS (SELECT item, unnest([{'annotator': 'ana', 'dim': 'correctness', 'score': quality}, {'annotator': 'bia', 'dim': 'correctness', 'score': quality + toxic},
  {'annotator': 'caio', 'dim': 'correctness', 'score': CASE WHEN n_chars % 7 = 0 THEN NULL ELSE (n_chars % 3)::INT END}, {'annotator': 'ana', 'dim': 'grounding', 'score': toxic},
  {'annotator': 'bia', 'dim': 'grounding', 'score': CASE WHEN n_chars % 5 > 0 THEN toxic END}], recursive := true) FROM x)"""


def pool(s, d):
    return an.eligible(f.results(s, d)).groupBy("result_id", "question_type", "rag").agg(F.min("chrf").alias("chrf")).withColumn("stratum", F.concat_ws("/", "question_type", "rag"))


_POOL = f"WITH {f.RESULT_SQL}, po AS (SELECT result_id, question_type || '/' || rag AS stratum FROM r WHERE answer NOT LIKE '[ERRO: %' GROUP BY ALL), av AS (SELECT stratum, count(*) AS available FROM po GROUP BY stratum)"
add("h1_eligible_pool", lambda s, d: pool(s, d).groupBy("stratum").agg(F.count("*").alias("available")), f"{_POOL} SELECT * FROM av")
_EQ = f"{_POOL}, al AS (SELECT stratum, available, 100 // (count(*) OVER ()) + (row_number() OVER (ORDER BY stratum) <= 100 % (count(*) OVER ()))::INT AS target FROM av)"
add("h2_h3_allocate_equal", lambda s, d: an.allocate(pool(s, d), "stratum", 100), f"{_EQ} SELECT stratum, available, target, target AS allocated, false AS short FROM al")
add(
    "h2_allocate_proportional", lambda s, d: an.allocate(pool(s, d), "stratum", 1000, "proportional"),
    f"""{_POOL}, e AS (SELECT *, available * 1000 / sum(available) OVER () AS x FROM av), g AS (SELECT *, floor(x)::BIGINT AS fl FROM e),
h AS (SELECT *, fl + (row_number() OVER (ORDER BY round(x - fl, 9) DESC, stratum) <= 1000 - sum(fl) OVER ())::INT AS target FROM g) SELECT stratum, available, target::BIGINT AS target, target::BIGINT AS allocated, false AS short FROM h""",
)
_SAMPLE = f"""{_EQ}, o AS (SELECT result_id, po.stratum, row_number() OVER (PARTITION BY po.stratum ORDER BY md5(concat_ws('|', 7, result_id)), result_id) AS n FROM po),
sm AS (SELECT result_id, o.stratum, row_number() OVER (ORDER BY md5(concat_ws('|', 7, 'p', result_id)), result_id, o.stratum) AS position FROM o JOIN al ON al.stratum = o.stratum AND n <= target)"""


def sampled(s, d):
    p = pool(s, d)
    return an.sample(p.select("result_id", "stratum"), "stratum", "result_id", an.allocate(p, "stratum", 100), 7)


add("h4_stratified_sample", sampled, f"{_SAMPLE} SELECT result_id, stratum, position FROM sm")


def order(s, d):
    items = f.table(s, d, "labels").select(F.col("doc_id").alias("item")).distinct()
    return an.annotator_order(items, notes(s, d).select("annotator").distinct().unionByName(s.createDataFrame([("davi",)], "annotator string")), 3)


_ORDER = f"WITH {_N}, aa AS (SELECT DISTINCT annotator FROM nt UNION SELECT 'davi'), od AS (SELECT annotator, item, row_number() OVER (PARTITION BY annotator ORDER BY md5(concat_ws('|', 3, annotator, item)), item) AS place FROM (SELECT DISTINCT doc_id AS item FROM labels), aa)"
add("h5_annotator_order", order, f"{_ORDER} SELECT annotator, item, place FROM od")
_QUEUE = f"{_ORDER}, dn AS (SELECT item, annotator, max(score IS NOT NULL) AS done FROM nt GROUP BY ALL), q AS (SELECT annotator, item, place, coalesce(done, false) AS done FROM od LEFT JOIN dn USING (item, annotator))"
add("h6_blind_queue", lambda s, d: an.queue(order(s, d), notes(s, d)), f"{_QUEUE} SELECT * FROM q")
add("h9_progress", lambda s, d: an.progress(order(s, d), notes(s, d)), f"{_QUEUE} SELECT annotator, count(*) FILTER (done) AS done, count(*) AS total FROM q GROUP BY annotator")


def wide(s, d):
    x = f.table(s, d, "labels").join(f.table(s, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return x.select(F.col("doc_id").alias("item"), (F.col("n_chars") % 2 == 0).alias("context"), F.when(F.col("n_chars") % 3 > 0, F.col("quality")).alias("correctness"), F.when(F.col("n_chars") % 4 > 0, F.col("toxic")).alias("grounding"), (F.col("n_chars") % 5 == 0).alias("cannot"), F.when(F.col("n_chars") % 10 == 0, "x").alias("reason"))


_WIDE = "w AS (SELECT l.doc_id AS item, n_chars % 2 = 0 AS context, CASE WHEN n_chars % 3 > 0 THEN quality END AS c, CASE WHEN n_chars % 4 > 0 THEN toxic END AS g, n_chars % 5 = 0 AS cannot, CASE WHEN n_chars % 10 = 0 THEN 'x' END AS reason FROM labels l JOIN documents d USING (doc_id))"
add(
    "h7_note_rules", lambda s, d: wide(s, d).select("item", an.note_violation(*(F.col(c) for c in ("context", "correctness", "grounding", "cannot", "reason"))).alias("violation")),
    f"WITH {_WIDE} SELECT item, CASE WHEN cannot AND reason IS NULL THEN 'reason missing' WHEN cannot AND (c IS NOT NULL OR g IS NOT NULL) THEN 'scores with cannot evaluate' WHEN cannot THEN NULL WHEN c IS NULL THEN 'correctness missing' WHEN context AND g IS NULL THEN 'grounding missing' WHEN NOT context AND g IS NOT NULL THEN 'grounding without passages' END AS violation FROM w",
)


def pair_notes(s, d):
    """Two combinations' common questions, judged by three annotators according to the two scores."""
    r = f.results(s, d)
    p = an.pair_round(r, "naive/retN/llmO", "oracle/retN/llmO", 5)
    v = r.groupBy("result_id").agg(F.max("chrf").alias("v"))
    p = p.join(v.select(F.col("result_id").alias("result_1"), F.col("v").alias("v1")), "result_1").join(v.select(F.col("result_id").alias("result_2"), F.col("v").alias("v2")), "result_2")
    best = F.when(F.abs(F.col("v1") - F.col("v2")) < 0.15, "tie").when((F.col("v1") > F.col("v2")) == F.col("a_is_1"), "A").otherwise("B")
    who = F.element_at(F.array(F.lit("ana"), F.lit("bia"), F.lit("caio")), (F.col("question") % 3 + 1).cast("int"))
    reasons = F.when(best == "tie", F.array().cast("array<string>")).when(F.col("question") % 2 == 0, F.array(F.lit("clear"), F.lit("complete"))).otherwise(F.array(F.lit("clear")))
    return p.select("question", "a_is_1", who.alias("annotator"), best.alias("preference"), reasons.alias("reasons"))


_PAIR = f"""WITH {f.RESULT_SQL}, la AS (SELECT combo, question, max(result_id) AS rid FROM r WHERE combo IN ('naive/retN/llmO', 'oracle/retN/llmO') GROUP BY ALL), vv AS (SELECT result_id, max(chrf) AS v FROM r GROUP BY ALL),
pr AS (SELECT a.question, a.rid AS result_1, b.rid AS result_2, substr(md5(concat_ws('|', 5, a.question)), 1, 1) < '8' AS a_is_1 FROM la a JOIN la b ON a.question = b.question AND a.combo = 'naive/retN/llmO' AND b.combo = 'oracle/retN/llmO'),
pn AS (SELECT question, a_is_1, ['ana', 'bia', 'caio'][question % 3 + 1] AS annotator, CASE WHEN abs(x.v - y.v) < 0.15 THEN 'tie' WHEN (x.v > y.v) = a_is_1 THEN 'A' ELSE 'B' END AS preference FROM pr JOIN vv x ON x.result_id = result_1 JOIN vv y ON y.result_id = result_2),
un AS (SELECT *, CASE WHEN preference = 'tie' THEN 'tie' WHEN (preference = 'A') = a_is_1 THEN '1' ELSE '2' END AS winner, CASE WHEN preference = 'tie' THEN [] WHEN question % 2 = 0 THEN ['clear', 'complete'] ELSE ['clear'] END AS reasons FROM pn)"""
add("h18_pair_round", lambda s, d: an.pair_round(f.results(s, d), "naive/retN/llmO", "oracle/retN/llmO", 5), f"{_PAIR} SELECT question, result_1, result_2, a_is_1 FROM pr")
add("h19_unblind", lambda s, d: an.unblind(pair_notes(s, d)).select("question", "preference", "winner"), f"{_PAIR} SELECT question, preference, winner FROM un")
add("h7_pair_rules", lambda s, d: pair_notes(s, d).withColumn("reasons", F.when(F.col("question") % 5 == 0, F.array(F.lit("odd"))).otherwise(F.col("reasons"))).select("question", an.pair_violation(F.col("preference"), F.col("reasons"), F.col("question") % 11 == 0, F.lit(None).cast("string"), ["clear", "complete"]).alias("violation")),
    f"{_PAIR}, z AS (SELECT question, preference, CASE WHEN question % 5 = 0 THEN ['odd'] ELSE reasons END AS reasons FROM un) SELECT question, CASE WHEN question % 11 = 0 THEN 'reason missing' WHEN preference = 'tie' AND len(reasons) > 0 THEN 'reasons for a tie' WHEN list_contains(reasons, 'odd') THEN 'unknown reasons' END AS violation FROM z")
add(
    "h20_pair_summary", lambda s, d: r6(an.pair_summary(an.unblind(pair_notes(s, d))), "p", "low", "high"),
    f"""{_PAIR}, g AS (SELECT annotator, count(*) FILTER (winner = '1') AS w1, count(*) FILTER (winner = '2') AS w2, count(*) FILTER (winner = 'tie') AS ties FROM un GROUP BY GROUPING SETS ((annotator), ())),
h AS (SELECT *, w1 + w2 AS n, least(w1, w2) AS k, w1 / (w1 + w2) AS q, 1.959963984540054 AS z FROM g),
t AS (SELECT annotator, n, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))) AS tail FROM (SELECT annotator, n, unnest(range(0, k + 1)) AS i FROM h WHERE n > 0) GROUP BY ALL)
SELECT h.annotator, w1 AS wins_1, w2 AS wins_2, ties, round(least(1, 2 * tail), 6) + 0 AS p, round((q + z * z / (2 * h.n) - z * sqrt(q * (1 - q) / h.n + z * z / (4 * h.n * h.n))) / (1 + z * z / h.n), 6) AS low, round((q + z * z / (2 * h.n) + z * sqrt(q * (1 - q) / h.n + z * z / (4 * h.n * h.n))) / (1 + z * z / h.n), 6) AS high FROM h LEFT JOIN t ON t.annotator IS NOT DISTINCT FROM h.annotator""",
)
add("h20_reason_counts", lambda s, d: an.reason_counts(an.unblind(pair_notes(s, d))), f"{_PAIR} SELECT winner, reason, count(*) AS n FROM (SELECT winner, unnest(reasons) AS reason FROM un WHERE winner <> 'tie') GROUP BY ALL")


def note_log(s, d):
    e = f.table(s, d, "events")
    return e.select(F.col("event_id").alias("note_id"), (F.col("user_id") % 50).alias("item"), F.col("event_type").alias("annotator"), F.lit("correctness").alias("dim"), (F.col("event_id") % 3).cast("int").alias("score"), F.col("ts").alias("updated_at"))


add("h8_latest_notes", lambda s, d: an.latest(note_log(s, d), s.createDataFrame([("error",)], "annotator string")).select("item", "annotator", "note_id", "score"),
    "SELECT item, annotator, note_id, score FROM (SELECT event_id AS note_id, user_id % 50 AS item, event_type AS annotator, (event_id % 3)::INT AS score, row_number() OVER (PARTITION BY user_id % 50, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE event_type <> 'error') WHERE k = 1")
_CO = f"""WITH {_N}, v AS (SELECT dim, item, score, count(*) AS c FROM nt WHERE score IS NOT NULL GROUP BY ALL), m AS (SELECT *, sum(c) OVER (PARTITION BY dim, item) AS m FROM v),
co AS (SELECT a.dim, a.score AS a, b.score AS b, sum(a.c * (b.c - (a.score = b.score)::INT) / (a.m - 1)) AS w FROM m a JOIN m b ON a.dim = b.dim AND a.item = b.item WHERE a.m > 1 GROUP BY ALL),
fr AS (SELECT dim, a, sum(w) AS f FROM co GROUP BY ALL), fu AS (SELECT *, sum(f) OVER (PARTITION BY dim ORDER BY a) AS u, sum(f) OVER (PARTITION BY dim) AS n FROM fr),
gd AS (SELECT x.dim, x.a, y.a AS b, x.f AS fa, y.f AS fb, x.n, greatest(x.u, y.u) - least(x.u, y.u) + CASE WHEN x.u <= y.u THEN x.f ELSE y.f END - (x.f + y.f) / 2 AS gap, coalesce(w, 0) AS w FROM fu x JOIN fu y ON x.dim = y.dim LEFT JOIN co ON co.dim = x.dim AND co.a = x.a AND co.b = y.a)"""
for level, delta in (("nominal", "(a <> b)::INT"), ("interval", "(a - b) ** 2"), ("ordinal", "gap ** 2")):
    add(f"h10_alpha_{level}", lambda s, d, level=level: r6(an.krippendorff(notes(s, d), ["dim"], level), "alpha"), f"{_CO} SELECT dim, round(1 - sum(w * {delta}) / (sum(fa * fb * {delta}) / (any_value(n) - 1)), 6) AS alpha FROM gd GROUP BY dim")


def rater_pairs(s, d):
    return f.table(s, d, "labels").join(f.table(s, d, "documents").select("doc_id", "n_chars", "lang"), "doc_id").select(F.col("doc_id").alias("item"), "lang", (F.col("quality") + F.col("toxic")).alias("x"), (F.col("quality") + F.when(F.col("n_chars") % 4 == 0, 1).otherwise(0)).alias("y"))


_PAIRS = "pp AS (SELECT l.doc_id AS item, lang, quality + toxic AS x, quality + (n_chars % 4 = 0)::INT AS y FROM labels l JOIN documents d USING (doc_id)), cf AS (SELECT lang, x, y, count(*) AS n FROM pp GROUP BY ALL)"
add("h11_confusion", lambda s, d: an.confusion(rater_pairs(s, d), ["lang"]), f"WITH {_PAIRS} SELECT * FROM cf")
for weights, w in (("none", "(x <> y)::INT"), ("linear", "abs(x - y)"), ("quadratic", "(x - y) ** 2")):
    add(
        f"h11_kappa_{weights}", lambda s, d, weights=weights: r6(an.kappa(rater_pairs(s, d), ["lang"], weights), "kappa"),
        f"""WITH {_PAIRS}, a AS (SELECT lang, x, sum(n) AS nx FROM cf GROUP BY ALL), b AS (SELECT lang, y, sum(n) AS ny FROM cf GROUP BY ALL), t AS (SELECT lang, sum(n) AS t FROM cf GROUP BY ALL),
e AS (SELECT lang, sum({w} * nx * ny / t / t) AS e FROM a JOIN b USING (lang) JOIN t USING (lang) GROUP BY lang), o AS (SELECT lang, sum({w} * n / t) AS o FROM cf JOIN t USING (lang) GROUP BY lang)
SELECT lang, round(1 - o / e, 6) + 0 AS kappa FROM e JOIN o USING (lang) WHERE e > 0 OR e = 0""",
    )
add("h12_kappa_interval", lambda s, d: r6(an.bootstrap_kappa(rater_pairs(s, d), ["lang"]), "low", "high"))  # random draws are not SQL


def decisions(s, d):
    return notes(s, d).where("item % 2 = 0").groupBy("item", "dim").agg(F.max("score").alias("score")).where("score is not null")


add(
    "h14_h15_final_notes", lambda s, d: an.final_notes(notes(s, d), decisions(s, d), f.table(s, d, "labels").select(F.col("doc_id").alias("item")).distinct()),
    f"""WITH {_N}, v AS (SELECT item, dim, count(DISTINCT score) AS k, count(score) AS n, min(score) AS common, max(score) AS top FROM nt WHERE score IS NOT NULL GROUP BY ALL),
st AS (SELECT item, CASE WHEN max(k) > 1 AND item % 2 > 0 THEN 'pendente' WHEN max(k) > 1 THEN 'adjudicada' WHEN max(n) >= 2 THEN 'concordância' WHEN max(n) = 1 THEN 'uma nota' ELSE 'sem notas' END AS status FROM v GROUP BY item)
SELECT item, status, dim, CASE WHEN k > 1 THEN CASE WHEN item % 2 = 0 THEN top END ELSE common END AS final FROM st JOIN v USING (item)""",
)
add("h13_disputed", lambda s, d: notes(s, d).where("score is not null").groupBy("item", "dim").agg(F.countDistinct("score").alias("k")).where("k > 1").select("item", "dim"), f"WITH {_N} SELECT item, dim FROM nt WHERE score IS NOT NULL GROUP BY ALL HAVING count(DISTINCT score) > 1")


def validation(s, d):
    from ragbench.operators.signals import spearman

    final = an.final_notes(notes(s, d), decisions(s, d), f.table(s, d, "labels").select(F.col("doc_id").alias("item")).distinct()).where("final is not null")
    docs = f.table(s, d, "documents").select(F.col("doc_id").alias("item"), F.col("n_chars").alias("auto"))
    return spearman(final.join(docs, "item"), ["dim"], "final", "auto", 2)


add("h16_h21_validation", lambda s, d: r6(validation(s, d), "rho"), f"""WITH {_N}, v AS (SELECT item, dim, count(DISTINCT score) AS k, min(score) AS common, max(score) AS top FROM nt WHERE score IS NOT NULL GROUP BY ALL),
fi AS (SELECT item, dim, CASE WHEN k > 1 THEN CASE WHEN item % 2 = 0 THEN top END ELSE common END AS final, n_chars AS auto FROM v JOIN documents d ON d.doc_id = item), w AS (SELECT * FROM fi WHERE final IS NOT NULL),
rk AS (SELECT dim, rank() OVER (PARTITION BY dim ORDER BY final) + (count(*) OVER (PARTITION BY dim, final) - 1) / 2 AS x, rank() OVER (PARTITION BY dim ORDER BY auto) + (count(*) OVER (PARTITION BY dim, auto) - 1) / 2 AS y FROM w)
SELECT dim, count(*) AS n, round(corr(x, y), 6) AS rho FROM rk GROUP BY dim""")
add("h22_duplicate_names", lambda s, d: an.duplicate_names(f.table(s, d, "documents").select(F.concat(F.when(F.col("doc_id") % 2 == 0, F.upper("source")).otherwise(F.col("source")), (F.col("doc_id") % 40).cast("string")).alias("name"))),
    "SELECT lower(source || doc_id % 40) AS name, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1 HAVING count(*) > 1")


def rounds(s, d):
    return f.table(s, d, "nation").select(F.col("n_nationkey").alias("round"), F.when(F.col("n_nationkey") % 4 == 1, F.col("n_nationkey") - 1).alias("source_round"))


add("h22_removable_rounds", lambda s, d: an.removable_rounds(rounds(s, d), f.table(s, d, "supplier").where("s_acctbal < 0").select(F.col("s_nationkey").alias("round"))).select("round"),
    "SELECT n_nationkey AS round FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0) AND n_nationkey % 4 <> 0 OR n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0) AND n_nationkey % 4 = 0 AND n_nationkey + 1 NOT IN (SELECT n_nationkey FROM nation)")


def grid_of(s, d):
    """The grid of the values that the results hold; documents' languages are the indexes."""
    def values(df, *columns):
        from pyspark.sql import Window
        x = df.select(*columns).distinct()
        return x.withColumn("no", F.row_number().over(Window.orderBy(*columns)))
    r = f.results(s, d)
    return gr.expand(values(r, "llm"), values(f.table(s, d, "documents").where("lang is not null").select(F.col("lang").alias("chunking"), F.lit("hash").alias("embedding")), "chunking", "embedding"), values(r, "rag"), values(r, "retriever"))


_GRID = f"""WITH {f.RESULT_SQL}, a AS (SELECT DISTINCT llm FROM r), b AS (SELECT DISTINCT lang AS chunking FROM documents WHERE lang IS NOT NULL), c AS (SELECT DISTINCT rag FROM r), e AS (SELECT DISTINCT retriever FROM r),
gg AS (SELECT * FROM a, b, c, e WHERE rag NOT IN ('closed_book', 'oracle') OR (retriever = (SELECT min(retriever) FROM e) AND chunking = (SELECT min(chunking) FROM b)))"""
add("x1_grid", grid_of, f"{_GRID} SELECT llm, chunking, 'hash' AS embedding, rag, retriever, row_number() OVER (ORDER BY llm, chunking, rag, retriever)::INT AS place FROM gg")
add("x1_distinct_combos", lambda s, d: gr.distinct_combos(f.results(s, d).groupBy("rag", "retriever", F.col("llm").alias("chunking"), F.lit("hash").alias("embedding")).agg(F.min("result_id").alias("no"))).select("rag", "no"),
    f"WITH {f.RESULT_SQL} SELECT rag, no FROM (SELECT rag, min(result_id) AS no FROM r GROUP BY rag, CASE WHEN rag NOT IN ('closed_book', 'oracle') THEN retriever END, CASE WHEN rag NOT IN ('closed_book', 'oracle') THEN llm END)")


def pending_runs(s, d):
    r = f.results(s, d)
    return gr.to_do(r.select("combo", "rag").distinct(), r.groupBy("question").agg(F.bool_or(F.col("question_type") != "ponte").alias("has_evidence")), r)


add("x4_to_do", pending_runs, f"""WITH {f.RESULT_SQL}, q AS (SELECT question, bool_or(question_type <> 'ponte') AS e FROM r GROUP BY question), w AS (SELECT combo, question FROM (SELECT DISTINCT combo, rag FROM r), q WHERE rag <> 'oracle' OR e)
SELECT combo, question FROM w EXCEPT SELECT combo, question FROM r WHERE answer NOT LIKE '[ERRO: %'""")


def index_pairs(s, d):
    return f.table(s, d, "documents").where("source is not null and lang is not null").select(F.col("source").alias("base"), F.lit("fixed").alias("chunking"), F.col("lang").alias("embedding"), "doc_id")


add("x3_missing_indexes", lambda s, d: gr.missing_indexes(index_pairs(s, d).drop("doc_id").distinct(), index_pairs(s, d).where("doc_id % 4 = 1 and embedding <> 'fr'").drop("doc_id")),
    "SELECT DISTINCT source AS base, 'fixed' AS chunking, lang AS embedding FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL AND source || '|' || lang NOT IN (SELECT source || '|' || lang FROM documents WHERE doc_id % 4 = 1 AND lang <> 'fr' AND source IS NOT NULL)")


def changes(s, d):
    c = f.table(s, d, "documents").select(F.col("source").alias("base"), "doc_id", "text")
    new = c.where("base <> 'src3'").withColumn("text", F.when(F.col("doc_id") % 97 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).withColumn("base", F.when(F.col("base") == "src4", "src44").otherwise(F.col("base")))
    return gr.fingerprint_changes(gr.fingerprint(c, ["base"], ["doc_id", "text"]), gr.fingerprint(new, ["base"], ["doc_id", "text"]), ["base"])


add("x6_fingerprint_changes", changes, "SELECT 'src3' AS base, 'removed' AS change UNION ALL SELECT 'src4', 'removed' UNION ALL SELECT 'src44', 'added' UNION ALL SELECT DISTINCT source, 'changed' FROM documents WHERE doc_id % 97 = 0 AND text IS NOT NULL AND source NOT IN ('src3', 'src4')")
add("x7_failure_streaks", lambda s, d: gr.failure_streaks(f.table(s, d, "events").select("user_id", "ts", "event_id", (F.col("event_type") != "error").alias("ok")), "user_id", ["ts", "event_id"], 2),
    "WITH e AS (SELECT user_id, event_type <> 'error' AS ok, sum((event_type <> 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS streak FROM events) SELECT user_id, streak, count(*) AS n FROM e WHERE NOT ok GROUP BY ALL HAVING count(*) >= 2")
add("x8_progress", lambda s, d: r6(gr.progress(f.results(s, d).where("answer = 'ok'").select("combo", "ts"), f.results(s, d).groupBy("combo").agg(F.count("*").alias("total")), "combo"), "eta"),
    f"WITH {f.RESULT_SQL} SELECT combo, count(*) FILTER (answer = 'ok') AS done, count(*) AS total, round((epoch(max(ts) FILTER (answer = 'ok'))::BIGINT - epoch(min(ts) FILTER (answer = 'ok'))::BIGINT) * (count(*) - count(*) FILTER (answer = 'ok')) / count(*) FILTER (answer = 'ok'), 6) AS eta FROM r GROUP BY combo")
def _status():
    return F.element_at(F.array(*map(F.lit, ("running", "scoring", "done", "failed"))), (F.col("event_id") % 4 + 1).cast("int"))


add("x9_last_phase", lambda s, d: gr.last_phase(f.table(s, d, "events").select(F.col("user_id").alias("experiment"), "ts", "event_id", _status().alias("status"))),
    "SELECT user_id AS experiment, CASE WHEN arg_max(event_id % 4, {'a': ts, 'b': event_id}) < 2 THEN 'paused' WHEN arg_max(event_id % 4, {'a': ts, 'b': event_id}) = 2 THEN 'done' ELSE 'failed' END AS status FROM events GROUP BY user_id")
add("x11_resumable", lambda s, d: gr.resumable(f.table(s, d, "orders").select(F.col("o_orderkey").alias("experiment"), F.element_at(F.array(*map(F.lit, ("paused", "failed", "done"))), (F.col("o_custkey") % 3 + 1).cast("int")).alias("status"), (F.col("o_custkey") % 5).alias("questions")), f.table(s, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("experiment"))),
    "SELECT o_orderkey AS experiment, ['paused', 'failed', 'done'][o_custkey % 3 + 1] AS status, CASE WHEN o_custkey % 3 = 2 THEN 'not paused or failed' WHEN o_custkey % 5 = 0 THEN 'no questions recorded' WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45) THEN 'inputs have changed' END AS reason FROM orders")
add("s8_in_use", lambda s, d: gr.in_use(f.table(s, d, "documents").where("n_chars > 9000").select(F.col("source").alias("base"), F.col("doc_id").alias("id")), f.table(s, d, "documents").where("lang = 'fr'").select(F.col("source").alias("base"), F.col("doc_id").alias("id"))),
    "SELECT base, arg_min(w, {'k': k, 'i': id}) || id0 AS reason FROM (SELECT base, k, id, CASE WHEN k = 0 THEN 'build ' ELSE 'experiment ' END AS w, first(id) OVER (PARTITION BY base ORDER BY k, id) AS id0 FROM (SELECT source AS base, 0 AS k, doc_id AS id FROM documents WHERE n_chars > 9000 UNION ALL SELECT source, 1, doc_id FROM documents WHERE lang = 'fr')) GROUP BY base, id0")

add("d1_dialogues", lambda s, d: dl.dialogues(f.table(s, d, "conversations")), "SELECT conv_id, count(*) AS messages, substr(arg_min(text, turn) FILTER (role = 'user'), 1, 80) AS first FROM conversations GROUP BY conv_id")
add("d1_rated_page", lambda s, d: dl.listed(f.table(s, d, "orders").select(F.col("o_orderkey").alias("conv_id"), F.col("o_orderdate").alias("created_at"), F.when(F.col("o_custkey") % 4 > 0, (F.col("o_custkey") % 11).cast("int")).alias("rating")), sort="best", page=2, size=50),
    "SELECT o_orderkey AS conv_id, o_orderdate AS created_at, CASE WHEN o_custkey % 4 > 0 THEN (o_custkey % 11)::INT END AS rating FROM orders ORDER BY rating DESC NULLS LAST, o_orderkey LIMIT 50 OFFSET 50")
add("d2_ordered_dialogue", lambda s, d: dl.ordered(f.table(s, d, "conversations")).select("conv_id", F.array_join(F.transform("messages", lambda m: m["role"]), ",").alias("roles"), F.sha2(F.array_join(F.transform("messages", lambda m: m["text"]), "\n"), 256).alias("digest")),
    "SELECT conv_id, string_agg(role, ',' ORDER BY turn, role, text) AS roles, sha256(string_agg(text, chr(10) ORDER BY turn, role, text)) AS digest FROM conversations GROUP BY conv_id")
add("d3_history", lambda s, d: dl.history(f.table(s, d, "conversations")).select("conv_id", "turn", "history"),
    "SELECT conv_id, turn, coalesce(string_agg(role || ': ' || text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS history FROM conversations")
def _reply():
    return F.concat(F.element_at(F.array(*map(F.lit, ("DIRECT", "RAG: ", "`rag", "\"Quem? ", "BLOCK "))), (F.col("turn") % 5 + 1).cast("int")), F.element_at(F.split("text", "\n"), 1), F.when(F.col("turn") % 2 == 1, "?").otherwise(""))


_REPLY_SQL = "['DIRECT', 'RAG: ', '`rag', '\"Quem? ', 'BLOCK '][turn % 5 + 1] || split_part(text, chr(10), 1) || CASE WHEN turn % 2 = 1 THEN '?' ELSE '' END"
add("d4_triage", lambda s, d: f.table(s, d, "conversations").withColumn("reply", _reply()).select("conv_id", "turn", *dl.triage(F.col("reply")), dl.blocked(F.col("reply")).alias("blocked")),
    f"""WITH x AS (SELECT conv_id, turn, trim({_REPLY_SQL}, ' "''`“”') AS fl FROM conversations) SELECT conv_id, turn, CASE WHEN upper(fl) LIKE 'DIRECT%' THEN 'direct' ELSE 'rag' END AS route,
CASE WHEN upper(fl) LIKE 'DIRECT%' THEN '' WHEN upper(fl) LIKE 'RAG%' THEN CASE WHEN contains(fl, ':') THEN trim(regexp_replace(fl, '^[^:]*:', ''), ' "''`“”') ELSE '' END WHEN fl LIKE '%?' THEN fl ELSE '' END AS query, upper(fl) LIKE 'BLOCK%' AS blocked FROM x""")
add("d5_message_rows", lambda s, d: dl.message_rows(dl.ordered(f.table(s, d, "conversations"))).select("conv_id", "position", "role"), "SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1)::INT AS position, role FROM conversations")

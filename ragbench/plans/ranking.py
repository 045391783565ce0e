"""Queries on rankings and chart aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ragbench.operators import ranking as op
from ragbench.plans import frames as f
from ragbench.sources.shared import written

QUERIES, SQL = {}, {}
_R = f"WITH {f.RESULT_SQL}, {f.LONG_SQL}, m AS (SELECT result_id, combo, question, question_type, avg(value) AS media FROM s GROUP BY ALL)"
_C = f"{_R}, cm AS (SELECT combo, avg(media) AS media, split_part(combo, '/', 1) AS rag, split_part(combo, '/', 2) AS retriever, split_part(combo, '/', 3) AS llm FROM m GROUP BY combo)"


def add(name, fn, sql=None):
    QUERIES[name] = fn
    if sql:
        SQL[name] = sql


def scores(s, d):
    return f.long_scores(f.results(s, d))


def row_means(s, d):
    return op.row_means(f.results(s, d), f.METRICS, f.table(s, d, "lineitem").count())


def combos(s, d):
    parts = F.split("combo", "/")
    return row_means(s, d).groupBy("combo").agg(F.avg("media").alias("media")).select("*", parts[0].alias("rag"), parts[1].alias("retriever"), parts[2].alias("llm"))


def r6(df, *columns):
    for c in columns:
        df = df.withColumn(c, F.round(c, 6) + F.lit(0.0))  # no negative zero
    return df


add("a1_row_means", lambda s, d: r6(row_means(s, d).select("result_id", "media"), "media"), f"{_R} SELECT result_id, round(media, 6) AS media FROM m")
add(
    "a2_a3_combination_ranking", lambda s, d: r6(op.rank_combinations(row_means(s, d)), "media"),
    f"""{_R}, g AS (SELECT combo, question_type, count(*) AS n, count(DISTINCT question) AS questions, avg(media) AS media, CASE WHEN grouping(combo) = 1 THEN 'type' WHEN grouping(question_type) = 1 THEN 'combo' ELSE 'combo_type' END AS level
  FROM m GROUP BY GROUPING SETS ((combo), (combo, question_type), (question_type)))
SELECT combo, question_type, n, questions, round(media, 6) AS media, level, rank() OVER (PARTITION BY level ORDER BY round(media, 9) DESC NULLS LAST, combo NULLS FIRST, question_type NULLS FIRST)::INT AS place FROM g""",
)
add("a2_metric_means", lambda s, d: r6(op.metric_means(scores(s, d)), "mean"), f"{_R} SELECT combo, metric, count(*) AS n, round(avg(value), 6) AS mean FROM s GROUP BY ALL")
add(
    "a4_best_of", lambda s, d: r6(op.best_of(op.metric_means(scores(s, d)).withColumn("mean", F.round("mean", 9))), "best"),
    f"{_R}, mm AS (SELECT combo, metric, round(avg(value), 9) AS mean FROM s GROUP BY ALL) SELECT metric, round(mean, 6) AS best, combo FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY mean DESC, combo) AS k FROM mm) WHERE k = 1",
)
add(
    "a5_results_page", lambda s, d: op.page(f.results(s, d).select("result_id", "combo", "chrf", "context_hit"), [F.desc(F.coalesce("context_hit", F.lit(-1.0))), F.desc("chrf"), F.col("result_id")], 3, 50, F.col("rag").isin("naive", "oracle")),
    f"WITH {f.RESULT_SQL} SELECT result_id, combo, chrf, context_hit FROM r WHERE rag IN ('naive', 'oracle') ORDER BY coalesce(context_hit, -1) DESC, chrf DESC, result_id LIMIT 50 OFFSET 100",
)
add("a6_metric_value", lambda s, d: r6(op.metric_value(f.results(s, d), "context_hit"), "value"), f"WITH {f.RESULT_SQL} SELECT combo, round(avg(context_hit), 6) AS value, count(context_hit) AS n, count(*) AS total FROM r GROUP BY combo")
_FOCUS = f"""{_C}, fo AS (SELECT combo, media, CASE WHEN row_number() OVER (ORDER BY round(media, 9) DESC, combo) <= 3 THEN 'top' WHEN row_number() OVER (ORDER BY round(media, 9), combo DESC) <= 3 THEN 'bottom' END AS focus FROM cm)"""


def focused(s, d):
    return op.focus(combos(s, d).withColumn("media", F.round("media", 9)), 3)


add("a7_focus", lambda s, d: r6(focused(s, d).select("combo", "media", "focus"), "media"), f"{_FOCUS} SELECT combo, round(media, 6) AS media, focus FROM fo WHERE focus IS NOT NULL")
add(
    "a8_metric_profile", lambda s, d: r6(op.metric_profile(scores(s, d), focused(s, d)), "top", "bottom", "gap"),
    f"{_FOCUS} SELECT metric, round(avg(value) FILTER (focus = 'top'), 6) AS top, round(avg(value) FILTER (focus = 'bottom'), 6) AS bottom, round(avg(value) FILTER (focus = 'bottom') - avg(value) FILTER (focus = 'top'), 6) AS gap FROM s JOIN fo USING (combo) WHERE focus IS NOT NULL GROUP BY metric",
)
_DIMS = ["rag", "retriever", "llm"]
add(
    "a9_dimension_effects", lambda s, d: r6(op.dimension_effects(combos(s, d), _DIMS), "best", "worst", "low", "high", "effect"),
    f"""{_C}, o AS (SELECT dim, option, avg(media) AS mean, min(media) AS low, max(media) AS high FROM (SELECT media, unnest([{{'dim': 'rag', 'option': rag}}, {{'dim': 'retriever', 'option': retriever}}, {{'dim': 'llm', 'option': llm}}], recursive := true) FROM cm) GROUP BY ALL)
SELECT dim, count(*) AS options, round(max(mean), 6) AS best, round(min(mean), 6) AS worst, round(min(low), 6) AS low, round(max(high), 6) AS high, round(max(mean) - min(mean), 6) AS effect, count(*) = 1 AS fixed FROM o GROUP BY dim""",
)
add("a9_grid_complete", lambda s, d: op.grid_complete(combos(s, d), _DIMS), f"{_C} SELECT count(DISTINCT combo) AS combos, count(DISTINCT rag) * count(DISTINCT retriever) * count(DISTINCT llm) AS cells, count(DISTINCT combo) = count(DISTINCT rag) * count(DISTINCT retriever) * count(DISTINCT llm) AS complete FROM cm")
add(
    "a10_cost_points", lambda s, d: r6(op.cost_points(f.results(s, d), "chrf"), "latency", "tokens", "quality"),
    f"WITH {f.RESULT_SQL} SELECT combo, round(avg(latency_ms) FILTER (latency_ms > 0), 6) AS latency, round(avg(tokens) FILTER (tokens > 0), 6) AS tokens, round(avg(chrf), 6) AS quality FROM r GROUP BY combo",
)


def points(s, d):
    """Orders as points: total price against the number of days since the first order."""
    return f.table(s, d, "orders").select("o_orderkey", F.round("o_totalprice", 2).alias("cost"), F.datediff("o_orderdate", F.lit("1992-01-01")).alias("quality"))


add(
    "a11_pareto", lambda s, d: op.pareto(points(s, d)),
    """WITH p AS (SELECT o_orderkey, round(o_totalprice, 2) AS cost, datediff('day', DATE '1992-01-01', o_orderdate::DATE)::INT AS quality FROM orders),
b AS (SELECT *, max(quality) OVER (PARTITION BY cost) AS best, max(quality) OVER (ORDER BY cost RANGE BETWEEN UNBOUNDED PRECEDING AND 0.001 PRECEDING) AS lower FROM p)
SELECT o_orderkey, cost, quality FROM b WHERE quality = best AND (lower IS NULL OR quality > lower)""",
)
def sketched(s, d):
    """Quartiles of each combination from sketches by combination and month; how far each is from its rank, in thousandths, must be within the bound."""
    rows = f.results(s, d).where("latency_ms is not null")
    parts = written(op.quantile_sketches(rows.withColumn("month", F.date_trunc("month", "ts")), ["combo", "month"], "latency_ms", 400), "sketches")
    q = op.sketched_quantiles(parts, ["combo"], {"q1": 0.25, "median": 0.5, "q3": 0.75})
    below = rows.join(q, "combo").groupBy("combo", "n").agg(*(F.avg((F.col("latency_ms") <= F.col(c)).cast("double")).alias(c) for c in ("q1", "median", "q3")))
    return below.select("combo", "n", *((F.abs(F.col(c) - at) < 0.03).alias(f"{c}_close") for c, at in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))))


add("a12_sketched_quartiles", sketched, f"WITH {f.RESULT_SQL} SELECT combo, count(latency_ms) AS n, true AS q1_close, true AS median_close, true AS q3_close FROM r GROUP BY combo")
add("a12_quartiles", lambda s, d: r6(op.quartiles(f.results(s, d), "combo", "latency_ms"), "q1", "median", "q3"), f"WITH {f.RESULT_SQL} SELECT combo, round(quantile_cont(latency_ms, 0.25), 6) AS q1, round(quantile_cont(latency_ms, 0.5), 6) AS median, round(quantile_cont(latency_ms, 0.75), 6) AS q3 FROM r GROUP BY combo")
add(
    "a13_question_matrix", lambda s, d: r6(op.question_matrix(f.results(s, d), "chrf"), "value", "difficulty"),
    f"WITH {f.RESULT_SQL}, c AS (SELECT question, combo, arg_min(chrf, {{'a': result_id, 'b': chrf}}) AS value FROM r GROUP BY ALL) SELECT question, combo, round(value, 6) AS value, round(avg(value) OVER (PARTITION BY question), 6) AS difficulty FROM c",
)
add(
    "a14_latency_summary", lambda s, d: r6(op.latency_summary(f.results(s, d), "llm", "latency_ms", "tokens"), "median", "p95", "seconds", "tokens", "req_s", "tok_s", "speed_up"),
    f"""WITH {f.RESULT_SQL}, g AS (SELECT llm, count(*) AS requests, quantile_disc(latency_ms, 0.5) AS median, quantile_disc(latency_ms, 0.95) AS p95, sum(latency_ms) / 1000 AS seconds, sum(tokens) AS tokens FROM r GROUP BY llm)
SELECT llm, requests, round(median, 6) AS median, round(p95, 6) AS p95, round(seconds, 6) AS seconds, tokens, round(requests / seconds, 6) AS req_s, round(tokens / seconds, 6) AS tok_s, round((requests / seconds) / first(requests / seconds) OVER (ORDER BY llm), 6) AS speed_up FROM g""",
)

"""Queries on comparisons and difficulty."""

from __future__ import annotations

from pyspark.sql import functions as F

from ragbench.functions.text import pt_tokens_sql
from ragbench.operators import comparison as cmp
from ragbench.operators import signals as sig
from ragbench.plans import frames as f
from ragbench.plans.ranking import r6, scores
from ragbench.plans.retrieval import _TOP

QUERIES, SQL = {}, {}


def add(name, fn, sql=None):
    QUERIES[name] = fn
    if sql:
        SQL[name] = sql


BASE = "naive/retN/llmO"
_K = f"WITH {f.RESULT_SQL}, {f.LONG_SQL}, k AS (SELECT combo, base, question, metric, avg(value) AS value, max(question_type) AS question_type FROM s WHERE answer NOT LIKE '[ERRO: %' GROUP BY ALL), c AS (SELECT * FROM k WHERE metric = 'chrf')"
_D = f"{_K}, df AS (SELECT o.combo, o.base, o.question, b.question_type, o.value - b.value AS diff FROM c o JOIN c b ON b.combo = '{BASE}' AND o.combo <> '{BASE}' AND o.base = b.base AND o.question = b.question)"


def means(s, d):
    return cmp.question_scores(f.long_scores(f.results(s, d), metrics=("chrf",)))


add("k1_question_scores", lambda s, d: r6(cmp.question_scores(scores(s, d)), "value"), f"{_K} SELECT combo, base, question, metric, round(value, 6) AS value, question_type FROM k")
def asked_for(s, d):
    """Of every experiment its runs, those of llmF under a name that no run has."""
    r = f.results(s, d).select("experiment", "combo")
    return cmp.requested(r.select("experiment", F.regexp_replace("combo", "llmF$", "llmX").alias("combo")), r, f.table(s, d, "orders").select(F.col("o_orderkey").alias("experiment")))


add("k2_requested_items", asked_for,
    f"WITH {f.RESULT_SQL}, q AS (SELECT DISTINCT experiment, regexp_replace(combo, 'llmF$', 'llmX') AS combo FROM r), k AS (SELECT DISTINCT experiment, combo, true AS k FROM r) SELECT experiment, combo, CASE WHEN k IS NULL THEN 'unknown run' END AS reason FROM q LEFT JOIN k USING (experiment, combo)")


def some_metrics(s, d):
    """Results without token_f1 in the combinations of llmF and without context_hit in closed_book ones."""
    return scores(s, d).where("not (metric = 'token_f1' and llm = 'llmF') and not (metric in ('context_hit', 'chrf') and rag = 'closed_book')")


_SOME = "sm AS (SELECT * FROM s WHERE NOT (metric = 'token_f1' AND llm = 'llmF') AND NOT (metric IN ('context_hit', 'chrf') AND rag = 'closed_book'))"
_PICK = "{sql} SELECT combo, CASE {whens} ELSE min(metric) END AS metric FROM sm GROUP BY combo"


def picked(*names):
    return _PICK.format(sql=f"{_K}, {_SOME}", whens=" ".join(f"WHEN bool_or(metric = '{m}') THEN '{m}'" for m in names))


add("k3_default_metric", lambda s, d: cmp.default_metric(some_metrics(s, d), ("answer_correctness", "token_f1")), picked("answer_correctness", "token_f1"))
add("k4_paired_differences", lambda s, d: r6(cmp.paired_differences(means(s, d), BASE), "diff"), f"{_D} SELECT combo, base, question, question_type, round(diff, 6) + 0 AS diff FROM df")
add("k4_k6_compare", lambda s, d: r6(cmp.compare(means(s, d), BASE), "mean_diff"), f"{_D} SELECT combo, coalesce(question_type, 'all') AS scope, count(*) AS n, round(avg(diff), 6) AS mean_diff FROM df GROUP BY GROUPING SETS ((combo), (combo, question_type))")
def apart(s, d):
    """Every combination answers the questions of its own third, but for one that answers all."""
    x = means(s, d)
    return x.where((F.col("combo") == "oracle/retA/llmF") | (F.col("question") % 3 == F.length("combo") % 3))


add("k4_without_common", lambda s, d: cmp.without_common(apart(s, d), BASE),
    f"{_K}, y AS (SELECT * FROM c WHERE combo = 'oracle/retA/llmF' OR question % 3 = length(combo) % 3) SELECT DISTINCT combo FROM y WHERE combo <> '{BASE}' AND combo NOT IN (SELECT o.combo FROM y o JOIN y b USING (base, question) WHERE b.combo = '{BASE}')")
# Random draws are not SQL; tests hold the intervals against plain resampling.
add("k5_bootstrap_interval", lambda s, d: r6(cmp.compare_intervals(means(s, d), BASE), "mean_diff", "low", "high"))


def placed(s, d):
    """Items are combinations of one base, so that the baseline's base has others beside it."""
    return means(s, d).withColumn("combo", F.concat_ws("@", "combo", "base"))


_AT = f"{_K}, ca AS (SELECT combo || '@' || base AS combo, base, question, question_type, value FROM c)"
add("k4_other_bases", lambda s, d: r6(cmp.other_bases(placed(s, d), BASE + "@0"), "mean"), f"{_AT} SELECT combo, count(*) AS n, round(avg(value), 6) AS mean FROM ca WHERE base <> 0 GROUP BY combo")
_ITEMS = ["naive/retN/llmO", "oracle/retN/llmO", "closed_book/retN/llmO"]
add(
    "k7_k8_friedman", lambda s, d: r6(cmp.friedman(means(s, d).withColumn("value", F.round("value", 9)), _ITEMS), "chi2", "p"),
    f"""{_K}, x AS (SELECT *, count(*) OVER (PARTITION BY base, question) AS cc FROM (SELECT combo, base, question, round(value, 9) AS value FROM c WHERE combo IN ({', '.join(repr(i) for i in _ITEMS)}))),
y AS (SELECT combo, rank() OVER (PARTITION BY base, question ORDER BY value) + (count(*) OVER (PARTITION BY base, question, value) - 1) / 2 AS rk FROM x WHERE cc = 3),
z AS (SELECT combo, sum(rk) AS sm, count(*) AS n FROM y GROUP BY combo)
SELECT any_value(n) AS questions, round(12 / (any_value(n) * 3 * 4) * sum(sm * sm) - 3 * any_value(n) * 4, 6) AS chi2, 2 AS df, round(exp(-(12 / (any_value(n) * 3 * 4) * sum(sm * sm) - 3 * any_value(n) * 4) / 2), 6) AS p FROM z""",
)

_PLAIN = {n: p.replace(r"\b(", r"(?:^|[^\p{L}\p{N}_])(").replace(r")\b", r")(?:$|[^\p{L}\p{N}_])").replace(r"^\W*(", r"^[^\p{L}\p{N}_]*(") for n, p in sig.PATTERNS.items()}
_FLAGS = ", ".join(f"coalesce(regexp_matches(lower(text), '{p}'), false)::INT::DOUBLE AS {n}" for n, p in _PLAIN.items())
add(
    "i2_i7_question_signals", lambda s, d: f.table(s, d, "documents").select("doc_id", *sig.question_signals(F.coalesce("text", F.lit("")))),
    f"SELECT doc_id, len({pt_tokens_sql('coalesce(text, chr(32))')})::DOUBLE AS question_length, greatest(1, length(coalesce(text, '')) - length(replace(coalesce(text, ''), '?', '')))::DOUBLE AS sub_questions, {_FLAGS} FROM documents",
)
add("i1_document_frequency", lambda s, d: sig.document_frequency(f.table(s, d, "documents")), f"SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct({pt_tokens_sql('text')})) AS token FROM documents WHERE text IS NOT NULL) GROUP BY token")


def corpus(s, d):
    docs = f.table(s, d, "documents").where("text is not null")
    return sig.corpus_signals(f.table(s, d, "benchmark").select(F.col("item_id").alias("qid"), "text"), sig.document_frequency(docs), docs.count())


add(
    "i8_i10_corpus_signals", lambda s, d: r6(corpus(s, d), "mean_idf", "max_idf", "out_of_corpus"),
    f"""WITH df AS (SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct({pt_tokens_sql('text')})) AS token FROM documents WHERE text IS NOT NULL) GROUP BY token),
t AS (SELECT item_id AS qid, unnest({pt_tokens_sql('text')}) AS token FROM benchmark), n AS (SELECT count(text) AS n FROM documents),
x AS (SELECT qid, df, ln((n + 1) / (coalesce(df, 0) + 1)) AS idf FROM t LEFT JOIN df USING (token), n)
SELECT qid, round(avg(idf), 6) AS mean_idf, round(max(idf), 6) AS max_idf, round(avg((df IS NULL)::INT), 6) AS out_of_corpus FROM x GROUP BY qid""",
)


def passages(s, d):
    """A question is a user turn, its evidence the turns of the conversation that follow."""
    return f.turns(s, d).select(F.col("id").alias("qid"), F.col("reference").alias("question"), F.array("answer").alias("passages"))


add(
    "i11_evidence_signals", lambda s, d: r6(sig.evidence_signals(passages(s, d)), "evidence_overlap"),
    f"""WITH {f.TURN_SQL}, x AS (SELECT id, unnest({pt_tokens_sql('reference')}) AS w, {pt_tokens_sql('answer')} AS e FROM tn), y AS (SELECT id, avg(list_contains(e, w)::INT) AS o FROM x GROUP BY id)
SELECT id AS qid, 1.0::DOUBLE AS evidence_count, round(coalesce(o, 0), 6) AS evidence_overlap FROM tn LEFT JOIN y USING (id)""",
)


def hits(s, d):
    from ragbench.operators.retrieval import top_k

    return top_k(f.vector_questions(s, d), f.vector_chunks(s, d), 5)


add(
    "i12_i14_retrieval_signals", lambda s, d: r6(sig.retrieval_signals(hits(s, d)), "top_score", "score_gap", "score_spread"),
    f"{_TOP} SELECT qid, round(max(score), 6) AS top_score, round(max(score) - max(score) FILTER (rank = 2), 6) AS score_gap, round(stddev_pop(score), 6) AS score_spread FROM tk WHERE rank <= 5 GROUP BY qid",
)


def labelled(s, d):
    return f.table(s, d, "embeddings").select(F.col("vec_id").alias("qid"), "label", F.col("embedding").alias("vector"))


add(
    "i15_evidence_distance", lambda s, d: r6(sig.evidence_distance_within(labelled(s, d).where("qid % 20 = 0"), labelled(s, d).withColumnRenamed("qid", "id")), "evidence_distance"),
    "SELECT q.vec_id AS qid, round(1 - min(list_cosine_similarity(q.embedding::DOUBLE[], p.embedding::DOUBLE[])), 6) AS evidence_distance FROM embeddings q JOIN embeddings p ON q.label = p.label AND q.vec_id % 20 = 0 GROUP BY q.vec_id",
)
add(
    "i16_perplexity", lambda s, d: r6(sig.perplexity(f.table(s, d, "events").select(F.col("event_type").alias("model"), F.col("user_id").alias("qid"), (-F.abs("value") / 100).alias("logprob"))), "perplexity"),
    "SELECT event_type AS model, user_id AS qid, round(exp(avg(abs(value) / 100)), 6) AS perplexity FROM events WHERE value IS NOT NULL GROUP BY ALL",
)
add(
    "i17_profile", lambda s, d: r6(corpus(s, d).join(f.table(s, d, "benchmark").select(F.col("item_id").alias("qid"), *sig.question_signals(F.col("text"))), "qid").select("qid", F.create_map(*(x for n in ("question_length", "sub_questions", "max_idf") for x in (F.lit(n), F.round(n, 6)))).alias("m")).select("qid", F.explode("m").alias("signal", "value")), "value"),
    f"""WITH df AS (SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct({pt_tokens_sql('text')})) AS token FROM documents WHERE text IS NOT NULL) GROUP BY token), n AS (SELECT count(text) AS n FROM documents),
t AS (SELECT item_id AS qid, unnest({pt_tokens_sql('text')}) AS token FROM benchmark), m AS (SELECT qid, max(ln((n + 1) / (coalesce(df, 0) + 1))) AS v FROM t LEFT JOIN df USING (token), n GROUP BY qid)
SELECT item_id AS qid, 'question_length' AS signal, len({pt_tokens_sql('text')})::DOUBLE AS value FROM benchmark UNION ALL SELECT item_id, 'sub_questions', greatest(1, length(text) - length(replace(text, '?', '')))::DOUBLE FROM benchmark UNION ALL SELECT qid, 'max_idf', round(v, 6) FROM m""",
)
_KIND = "CASE WHEN rag IN ('closed_book', 'oracle') THEN rag ELSE 'retrieval' END"
add(
    "i18_observed_difficulty", lambda s, d: r6(sig.observed_difficulty(scores(s, d)), "mean", "std"),
    f"WITH {f.RESULT_SQL}, {f.LONG_SQL} SELECT question, llm, {_KIND} AS kind, metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, count(*) AS n FROM s WHERE answer NOT LIKE '[ERRO: %' GROUP BY ALL",
)
add(
    "i18_by_hit", lambda s, d: r6(sig.by_hit(f.results(s, d), "chrf"), "hit_rate", "with_evidence", "without_evidence"),
    f"WITH {f.RESULT_SQL} SELECT question, round(avg(context_hit), 6) AS hit_rate, round(avg(chrf) FILTER (context_hit = 1), 6) AS with_evidence, round(avg(chrf) FILTER (context_hit = 0), 6) AS without_evidence FROM r WHERE answer NOT LIKE '[ERRO: %' GROUP BY question",
)
add("i19_preferred_metric", lambda s, d: cmp.default_metric(some_metrics(s, d), ("context_hit", "token_f1", "answer_correctness", "rouge_l")), picked("context_hit", "token_f1", "answer_correctness", "rouge_l"))


def responses(s, d):
    """Scopes: all, by model, by type. A question's rows lie together before they are multiplied by scopes, so those are not shuffled."""
    r = f.results(s, d).where("chrf is not null and answer = 'ok'").withColumnRenamed("chrf", "value")
    r = r.select("rag", "retriever", "llm", "question", "question_type", "result_id", "value").repartition("question")
    scope = F.explode(F.array(F.lit("all"), F.concat(F.lit("llm="), "llm"), F.concat(F.lit("type="), "question_type")))
    return r.select(scope.alias("scope"), F.concat_ws("/", "rag", "retriever").alias("config"), "llm", "question", "result_id", "value")


_CELLS = f"""{f.RESULT_SQL}, x AS (SELECT unnest(['all', 'llm=' || llm, 'type=' || question_type]) AS scope, rag || '/' || retriever AS config, llm, question, result_id, chrf FROM r WHERE answer = 'ok'),
cells AS MATERIALIZED (SELECT scope, config || '/' || llm AS person, question, least(greatest(arg_max(chrf, {{'a': result_id, 'b': chrf}}), 0), 1) AS y FROM x GROUP BY scope, config, llm, question)"""


def rasch_sql(steps: int = 25) -> str:
    """The alternating steps, one after the other: by then nothing moves any more."""
    parts = [f"WITH {_CELLS}, z AS (SELECT scope, count(DISTINCT question) AS n FROM cells GROUP BY scope HAVING n >= 3), w AS MATERIALIZED (SELECT cells.* FROM cells JOIN z USING (scope))",
             "t0 AS (SELECT DISTINCT scope, person, 0::DOUBLE AS t FROM w)", "b0 AS (SELECT DISTINCT scope, question, 0::DOUBLE AS b FROM w)", "m0 AS (SELECT DISTINCT scope, 0::DOUBLE AS m FROM w)"]
    one = "{k} AS MATERIALIZED (SELECT scope, {key}, {v} + greatest(-1, least(1, ({sign} * sum(y - p) - 0.1 * ({v} - m)) / (sum(p * (1 - p)) + 0.1))) AS {v} FROM (SELECT *, 1 / (1 + exp(b - t)) AS p FROM w JOIN {t} USING (scope, person) JOIN {b} USING (scope, question) JOIN {m} USING (scope)) GROUP BY scope, {key}, {v}, m)"
    for k in range(steps):
        parts.append(one.format(k=f"t{k + 1}", key="person", v="t", sign="1", t=f"t{k}", b=f"b{k}", m=f"m{k}"))
        parts.append(one.format(k=f"b{k + 1}", key="question", v="b", sign="-1", t=f"t{k + 1}", b=f"b{k}", m=f"m{k}"))
        parts.append(f"m{k + 1} AS MATERIALIZED (SELECT scope, avg(b) AS m FROM b{k + 1} GROUP BY scope)")
    return ", ".join(parts) + f" SELECT scope, question, round(b - m, 6) + 0 AS difficulty, n >= 50 AS reliable FROM b{steps} JOIN m{steps} USING (scope) JOIN z USING (scope)"


add("i20_i21_rasch", lambda s, d: r6(sig.rasch(sig.rasch_cells(responses(s, d))), "difficulty"), rasch_sql())
add(
    "i20_rasch_cells", lambda s, d: r6(sig.rasch_cells(responses(s, d)), "y"),
    f"WITH {_CELLS} SELECT scope, person, question, round(y, 6) AS y FROM cells",
)


def hardness(s, d):
    r = f.results(s, d).where("answer = 'ok'")
    return r.groupBy("question", F.col("llm").alias("scope")).agg(F.round(F.avg("chrf"), 9).alias("difficulty"), F.round(F.avg("latency_ms"), 6).alias("price"), F.count("*").alias("rows"), F.round(F.avg("tokens"), 6).alias("tokens"))


_HARD = f"WITH {f.RESULT_SQL}, h AS (SELECT question, llm AS scope, round(avg(chrf), 9) AS difficulty, round(avg(latency_ms), 6) AS price, count(*) AS rows, round(avg(tokens), 6) AS tokens FROM r WHERE answer = 'ok' GROUP BY ALL)"


def _rank(by, x):
    return f"rank() OVER (PARTITION BY {by} ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2"


add("i22_spearman", lambda s, d: r6(sig.spearman(hardness(s, d), ["scope"], "price", "difficulty"), "rho"), f"{_HARD}, k AS (SELECT scope, {_rank('scope', 'price')} AS x, {_rank('scope', 'difficulty')} AS y FROM h) SELECT scope, count(*) AS n, round(corr(x, y), 6) AS rho FROM k GROUP BY scope")


def correlations(s, d):
    h = hardness(s, d)
    signals = f.results(s, d).where("answer = 'ok'").groupBy("question").agg(F.round(F.avg("latency_ms"), 6).alias("price"), F.count("*").alias("rows"))
    return sig.signal_correlations(signals, h.select("question", "scope", "difficulty"), ["price", "rows"])


add(
    "i23_signal_correlations", lambda s, d: r6(correlations(s, d), "rho"),
    f"""{_HARD}, g AS (SELECT question, unnest([{{'signal': 'price', 'value': round(avg(latency_ms), 6)}}, {{'signal': 'rows', 'value': count(*)::DOUBLE}}], recursive := true) FROM r WHERE answer = 'ok' GROUP BY question),
j AS (SELECT signal, scope, value, difficulty FROM g JOIN h USING (question)), k AS (SELECT signal, scope, {_rank('signal, scope', 'value')} AS x, {_rank('signal, scope', 'difficulty')} AS y FROM j)
SELECT signal, scope, count(*) AS n, round(corr(x, y), 6) AS rho FROM k GROUP BY ALL""",
)
_STOP = ["the", "and", "of", "is", "le", "la", "de", "die", "und"]
add(
    "i24_lexical_echo", lambda s, d: r6(sig.lexical_echo(f.turns(s, d).select(F.col("id").alias("qid"), F.col("reference").alias("question"), F.col("answer").alias("evidence")), _STOP), "echo"),
    "WITH " + f.TURN_SQL + ", w AS (SELECT id, " + ", ".join(
        rf"list_filter(list_distinct(string_split(trim(regexp_replace(strip_accents(lower({c})), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ')), lambda x: length(x) > 1 AND x NOT IN ({', '.join(repr(x) for x in _STOP)})) AS {n}" for c, n in (("reference", "q"), ("answer", "e"))
    ) + " FROM tn) SELECT id AS qid, CASE WHEN len(q) > 0 THEN round(len(list_intersect(q, e)) / len(q), 6) END AS echo FROM w",
)
add(
    "i25_hardest_first", lambda s, d: r6(sig.hardest_first(hardness(s, d).where("scope = 'llmO'").select("question", F.when(F.col("rows") > 3, 1 - F.col("difficulty")).alias("irt"), F.col("difficulty").alias("mean"))).select("question", "key"), "key"),
    f"{_HARD} SELECT question, round(coalesce(CASE WHEN rows > 3 THEN 1 - difficulty END, -difficulty, -2), 6) AS key FROM h WHERE scope = 'llmO'",
)

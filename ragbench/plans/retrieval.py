"""Queries on chunks, vectors, retrieval and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ragbench.functions.text import normal_words_sql, pt_tokens_sql, words_sql
from ragbench.functions.vectors import cosine, hash_embedding
from ragbench.operators import chunking, metrics, retrieval
from ragbench.plans import frames as f

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


_FIXED = """x AS (SELECT doc_id AS doc, text, unnest(range(0, greatest(length(text) - 100, 1), 900)) AS pos FROM documents WHERE text IS NOT NULL),
y AS (SELECT doc, pos, trim(substr(text, pos + 1, 1000)) AS text FROM x),
ch AS (SELECT doc, (row_number() OVER (PARTITION BY doc ORDER BY pos) - 1)::INT AS chunk_index, text FROM y WHERE text <> '')"""
query("c1_fixed_chunks", f"WITH {_FIXED} SELECT * FROM ch")(lambda s, d: chunking.fixed(f.docs(s, d)))
#: The folder of public vocabularies.
VOCABULARIES = "/opt/tokenizers"
query("c3_subword_chunks")(lambda s, d: chunking.subword_tokens(f.docs(s, d), f"{VOCABULARIES}/byte_bpe_50k.tiktoken"))
query("c2_recursive_chunks")(lambda s, d: chunking.recursive(f.docs(s, d)))
query("c3_token_chunks", f"""WITH t AS (SELECT doc_id AS doc, {words_sql('text')} AS t FROM documents WHERE text IS NOT NULL),
x AS (SELECT doc, t, unnest(range(0, greatest(len(t) - 20, 1), 236)) AS pos FROM t WHERE len(t) > 0)
SELECT doc, (row_number() OVER (PARTITION BY doc ORDER BY pos) - 1)::INT AS chunk_index, array_to_string(t[pos + 1:pos + 256], ' ') AS text FROM x""")(lambda s, d: chunking.tokens(f.docs(s, d)))


def _headed(s, d):
    """Documents whose every third line becomes a heading of level 1 to 3."""
    lines = F.split("text", "\n", -1)
    marked = F.transform(lines, lambda x, i: F.when((i % 3 == 0) & (F.btrim(x) != ""), F.concat(F.repeat(F.lit("#"), (F.floor(i / 3) % 3 + 1).cast("int")), F.lit(" "), F.btrim(x))).otherwise(x))
    return f.docs(s, d).where("text is not null").withColumn("text", F.array_join(marked, "\n"))


query("c4_markdown_sections", """WITH l AS (SELECT doc_id AS doc, unnest(range(len(x))) AS no, unnest(x) AS raw FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL)),
h AS (SELECT doc, no, CASE WHEN no % 3 = 0 AND trim(raw) <> '' THEN (no // 3) % 3 + 1 END AS level, CASE WHEN no % 3 = 0 AND trim(raw) <> '' THEN repeat('#', ((no // 3) % 3 + 1)::INT) || ' ' || trim(raw) ELSE raw END AS line FROM l),
p AS (SELECT *, count(level) OVER w AS section, max(CASE WHEN level = 1 THEN no END) OVER w AS n1, max(CASE WHEN level = 2 THEN no END) OVER w AS n2, max(CASE WHEN level = 3 THEN no END) OVER w AS n3 FROM h WINDOW w AS (PARTITION BY doc ORDER BY no)),
q AS (SELECT p.doc, p.no, p.section, p.level, p.line, concat_ws(chr(10), a.line, CASE WHEN n2 > coalesce(n1, -1) THEN b.line END, CASE WHEN n3 > coalesce(n1, -1) AND n3 > coalesce(n2, -1) THEN c.line END) AS path
  FROM p LEFT JOIN h a ON a.doc = p.doc AND a.no = n1 LEFT JOIN h b ON b.doc = p.doc AND b.no = n2 LEFT JOIN h c ON c.doc = p.doc AND c.no = n3),
g AS (SELECT doc, section, max(path) AS path, trim(coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (level IS NULL), ''), ' ') AS body FROM q GROUP BY doc, section)
SELECT doc, section, path, body FROM g WHERE body <> ''""")(lambda s, d: chunking.markdown_sections(_headed(s, d)))
query("c4_markdown_chunks")(lambda s, d: chunking.markdown(_headed(s, d)))
_HASHED = "(('0x' || substr(md5(w), 1, 7))::BIGINT % 128)"
query("c5_semantic_chunks", f"""WITH sp AS (SELECT doc_id AS doc, string_split(regexp_replace(trim(text, ' '), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS x FROM documents WHERE text IS NOT NULL),
se AS (SELECT * FROM (SELECT doc, unnest(range(len(x))) AS no, unnest(x) AS sentence FROM sp) WHERE trim(sentence, ' ') <> ''),
wd AS (SELECT doc, no, unnest({words_sql('sentence')}) AS w FROM se), ve AS (SELECT doc, no, {_HASHED} % 64 AS p, sum(CASE WHEN {_HASHED} < 64 THEN 1 ELSE -1 END)::DOUBLE AS v FROM wd GROUP BY ALL),
sz AS (SELECT doc, no, sqrt(sum(v * v)) AS n FROM ve GROUP BY ALL), pv AS (SELECT doc, no, sentence, lag(no) OVER (PARTITION BY doc ORDER BY no) AS before FROM se),
dt AS (SELECT pv.doc, pv.no, sum(a.v * b.v) AS x FROM pv JOIN ve a ON a.doc = pv.doc AND a.no = pv.no JOIN ve b ON b.doc = pv.doc AND b.no = before AND b.p = a.p GROUP BY ALL),
ds AS (SELECT pv.*, CASE WHEN before IS NOT NULL THEN round(1 - CASE WHEN coalesce(s1.n, 0) * coalesce(s2.n, 0) = 0 THEN 0 ELSE coalesce(x, 0) / (s1.n * s2.n) END, 12) END AS d FROM pv LEFT JOIN dt USING (doc, no) LEFT JOIN sz s1 ON s1.doc = pv.doc AND s1.no = pv.no LEFT JOIN sz s2 ON s2.doc = pv.doc AND s2.no = before),
li AS (SELECT doc, CASE WHEN count(d) = 1 THEN 0.5 ELSE round(quantile_cont(d, 0.9), 13) END AS cut FROM ds GROUP BY doc),
pt AS (SELECT ds.doc, no, sentence, sum(coalesce((d > cut)::INT, 0)) OVER (PARTITION BY ds.doc ORDER BY no) AS part FROM ds JOIN li USING (doc)),
tx AS (SELECT doc, part, trim(string_agg(sentence, ' ' ORDER BY no)) AS text FROM pt GROUP BY ALL)
SELECT doc, (row_number() OVER (PARTITION BY doc ORDER BY part) - 1)::INT AS chunk_index, text FROM tx WHERE text <> ''""")(lambda s, d: chunking.semantic(f.docs(s, d)))
query("c6_single_chunk_warnings", f"SELECT doc_id AS doc, length(text)::INT AS n_chars FROM documents WHERE length(text) > 2000 AND len({words_sql('text')}) BETWEEN 1 AND 600")(
    lambda s, d: chunking.single_chunk_warnings(chunking.tokens(f.docs(s, d), 600, 20), f.docs(s, d))
)
query("c6_ingest_grid", f"""WITH {_FIXED}, t AS (SELECT doc_id AS doc, {words_sql('text')} AS t FROM documents WHERE text IS NOT NULL),
x2 AS (SELECT doc, t, unnest(range(0, greatest(len(t) - 20, 1), 236)) AS pos FROM t WHERE len(t) > 0),
al AS (SELECT 'fixed' AS chunking, doc, length(text) AS n FROM ch UNION ALL SELECT 'token', doc, length(array_to_string(t[pos + 1:pos + 256], ' ')) FROM x2)
SELECT chunking, 'hash' AS embedding, count(*) AS chunks, count(DISTINCT doc) AS docs, sum(n)::BIGINT AS chars FROM al GROUP BY chunking""")(
    lambda s, d: chunking.ingest(f.docs(s, d), ["fixed", "token"], {"hash": hash_embedding}).groupBy("chunking", "embedding").agg(F.count("*").alias("chunks"), F.countDistinct("doc").alias("docs"), F.sum(F.length("text")).alias("chars"))
)

_TOP = f"""WITH {f.CHUNK_SQL}, q AS (SELECT vec_id AS qid, label, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id % 20 = 0),
sc AS (SELECT qid, q.label, chunk_id, doc, chunk_index, round(list_cosine_similarity(qv, vector), 9) AS score FROM q, c),
tk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id)::INT AS rank FROM sc)"""
query("v2_cosine", "SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], list_reverse(embedding::DOUBLE[])), 6) AS similarity FROM embeddings")(
    lambda s, d: f.table(s, d, "embeddings").select("vec_id", F.round(cosine(F.col("embedding"), F.reverse("embedding")), 6).alias("similarity"))
)
query("v3_exact_top_k", f"{_TOP} SELECT qid, rank, chunk_id, round(score, 6) AS score FROM tk WHERE rank <= 10")(
    lambda s, d: retrieval.top_k(f.vector_questions(s, d), f.vector_chunks(s, d), 10).withColumn("score", F.round("score", 6))
)
query("v4_approximate_top_k")(lambda s, d: retrieval.approximate_top_k(f.vector_questions(s, d), f.vector_chunks(s, d), 10))
query("r1_similarity", f"{_TOP} SELECT qid, rank, chunk_id, round(score, 6) AS score FROM tk WHERE rank <= 5")(
    lambda s, d: retrieval.similarity(f.vector_questions(s, d), f.vector_chunks(s, d)).withColumn("score", F.round("score", 6))
)
query("r2_mmr", f"""{_TOP.replace("WITH", "WITH RECURSIVE", 1)}, nr AS MATERIALIZED (SELECT qid, tk.rank, tk.chunk_id, score, vector FROM tk JOIN c ON c.chunk_id = tk.chunk_id WHERE tk.rank <= 20),
sm AS MATERIALIZED (SELECT a.qid, a.rank, any_value(a.chunk_id) AS chunk_id, any_value(a.score) AS score, list(list_cosine_similarity(a.vector, b.vector) ORDER BY b.rank) AS sims FROM nr a JOIN nr b USING (qid) GROUP BY a.qid, a.rank),
ch AS (SELECT qid, 0 AS k, []::INT[] AS chosen FROM q UNION ALL SELECT ch.qid, k + 1, list_append(chosen, arg_max(rank, {{'v': round(0.5 * score - 0.5 * coalesce(list_max(list_transform(chosen, lambda x: sims[x])), 0), 12), 'r': -rank}})) FROM ch JOIN sm ON sm.qid = ch.qid AND NOT list_contains(chosen, rank) WHERE k < 5 GROUP BY ch.qid, k, chosen)
SELECT qid, o.rank, chunk_id, round(score, 6) AS score FROM (SELECT qid, unnest(chosen) AS r, unnest(range(1, 6))::INT AS rank FROM ch WHERE k = 5) o JOIN (SELECT qid, rank AS r, chunk_id, score FROM sm) USING (qid, r)""")(
    lambda s, d: retrieval.mmr(f.vector_questions(s, d), f.vector_chunks(s, d)).withColumn("score", F.round("score", 6))
)


def _variants(s, d):
    e = f.table(s, d, "embeddings")
    return e.where("vec_id % 20 < 3").select((F.col("vec_id") - F.col("vec_id") % 20).alias("qid"), (F.col("vec_id") % 20).cast("int").alias("variant"), F.col("embedding").alias("vector"))


query("r3_multi_query", f"""WITH {f.CHUNK_SQL}, q AS (SELECT vec_id - vec_id % 20 AS qid, vec_id % 20 AS variant, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id % 20 < 3),
sc AS (SELECT qid, variant, chunk_id, round(list_cosine_similarity(qv, vector), 9) AS score FROM q, c),
tk AS (SELECT *, row_number() OVER (PARTITION BY qid, variant ORDER BY score DESC, chunk_id) AS rank FROM sc),
fi AS (SELECT *, row_number() OVER (PARTITION BY qid, chunk_id ORDER BY variant, rank) AS n FROM tk WHERE rank <= 5)
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY variant, rank)::INT AS rank, chunk_id, round(score, 6) AS score FROM fi WHERE n = 1""")(
    lambda s, d: retrieval.multi_query(_variants(s, d), f.vector_chunks(s, d)).withColumn("score", F.round("score", 6))
)
query("r4_parent_document", f"""{_TOP} SELECT qid, rank, h.doc, h.chunk_index, round(score, 6) AS score, string_agg('v' || n.chunk_id, ' ' ORDER BY n.chunk_index) AS text
FROM (SELECT * FROM tk WHERE rank <= 3) h JOIN c n ON n.doc = h.doc AND n.chunk_index BETWEEN h.chunk_index - 1 AND h.chunk_index + 1 GROUP BY ALL""")(
    lambda s, d: retrieval.parent_document(
        retrieval.top_k(f.vector_questions(s, d), f.vector_chunks(s, d), 3).hint("merge").join(f.vector_chunks(s, d).select("chunk_id", "doc", "chunk_index"), "chunk_id"), f.vector_chunks(s, d)
    ).withColumn("score", F.round("score", 6))
)


def _evidence(s, d):
    """Benchmark passages as questions; their two halves (by words) are the evidence of hops 1 and 2."""
    t = F.split("text", " ")
    half = F.greatest(F.floor(F.size(t) / 2), F.lit(1)).cast("int")
    b = f.table(s, d, "benchmark")
    parts = F.array(F.struct(F.lit(1).alias("hop"), F.array_join(F.slice(t, 1, half), " ").alias("passage")), F.struct(F.lit(2).alias("hop"), F.array_join(F.slice(t, half + 1, F.size(t)), " ").alias("passage")))
    return b.select(F.col("item_id").alias("qid"), F.explode(parts).alias("p")).select("qid", F.col("p.hop").alias("passage_no"), "p.hop", "p.passage")


def _contexts(s, d):
    """For each question the five chunks that share most runs of eight words with it.

    A chunk is known by the pair (doc, chunk_index); chunk_id is only its name in the result.
    """
    from pyspark.sql import Window

    c = chunking.fixed(f.docs(s, d)).select(F.struct("doc", "chunk_index").alias("id"), "text")
    q = f.table(s, d, "benchmark").select(F.col("item_id").alias("id"), "text")
    near = retrieval.shared_shingles(q, c)
    rank = F.row_number().over(Window.partitionBy("left_id").orderBy(F.desc("shared"), "right_id"))
    near = near.withColumn("rank", rank).where("rank <= 5")
    return near.hint("merge").join(c, near["right_id"] == c["id"]).select(F.col("left_id").alias("qid"), "rank", (F.col("right_id.doc") * 1000 + F.col("right_id.chunk_index")).alias("chunk_id"), "text")


def _runs(source: str, key: str, name: str) -> str:
    return f"SELECT DISTINCT {key} AS {name}, array_to_string(t[i:i + 7], ' ') AS run FROM (SELECT {key}, t, unnest(range(1, greatest(len(t) - 7, 1) + 1)) AS i FROM (SELECT {key}, string_split({normal_words_sql('text')}, ' ') AS t FROM {source}))"


_CONTEXT = f"""{_FIXED}, cc AS (SELECT doc * 1000 + chunk_index AS id, text FROM ch),
ru AS ({_runs('benchmark', 'item_id', 'qid')}), rc AS ({_runs('cc', 'id', 'cid')}),
nn AS (SELECT qid, cid, count(*) AS shared FROM ru JOIN rc USING (run) GROUP BY ALL),
nr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY shared DESC, cid)::INT AS rank FROM nn),
ctx AS (SELECT qid, rank, cid AS chunk_id, cc.text FROM nr JOIN cc ON cc.id = cid WHERE rank <= 5),
bt AS (SELECT item_id, string_split(text, ' ') AS t FROM benchmark), bh AS (SELECT item_id, t, greatest(len(t) // 2, 1) AS h FROM bt),
ev AS (SELECT item_id AS qid, 1 AS hop, array_to_string(t[1:h], ' ') AS passage FROM bh UNION ALL SELECT item_id, 2, array_to_string(t[h + 1:], ' ') FROM bh),
ma AS (SELECT ev.qid, hop, rank, chunk_id, coalesce({normal_words_sql('passage')} <> '' AND length({normal_words_sql('text')}) >= 0.5 * length({normal_words_sql('passage')}) AND contains({normal_words_sql('text')}, {normal_words_sql('passage')}), false) AS found FROM ev LEFT JOIN ctx USING (qid))"""
query("v7_shared_runs", f"WITH {_CONTEXT} SELECT qid, rank, chunk_id FROM ctx")(lambda s, d: _contexts(s, d).drop("text"))
query("e6_evidence_matches", f"WITH {_CONTEXT} SELECT qid, hop, rank, found FROM ma")(
    lambda s, d: metrics.evidence_matches(_evidence(s, d), _contexts(s, d), fuzzy=False).select("qid", "hop", "rank", "found")
)
query("e6_fuzzy_matches")(lambda s, d: metrics.evidence_matches(_evidence(s, d), _contexts(s, d)).select("qid", "hop", "rank", "found"))
_GOLD = """SELECT a.qid, a.hit AS context_hit, round(a.mrr, 6) AS context_mrr, round(p.v, 6) AS context_recall_gold, h.v AS context_all_hops
FROM (SELECT qid, max(found::INT)::DOUBLE AS hit, coalesce(1 / min(rank) FILTER (found), 0) AS mrr FROM ma GROUP BY qid) a
JOIN (SELECT qid, avg(x::INT) AS v FROM (SELECT qid, hop, bool_or(found) AS x FROM ma GROUP BY ALL) GROUP BY qid) p USING (qid)
JOIN (SELECT qid, bool_and(x)::INT::DOUBLE AS v FROM (SELECT qid, hop, bool_or(found) AS x FROM ma GROUP BY ALL) GROUP BY qid) h USING (qid)"""


def gold(s, d):
    out = metrics.gold_metrics(metrics.evidence_matches(_evidence(s, d), _contexts(s, d), fuzzy=False))
    return out.withColumn("context_mrr", F.round("context_mrr", 6)).withColumn("context_recall_gold", F.round("context_recall_gold", 6))


query("e7_e10_gold_metrics", f"WITH {_CONTEXT} {_GOLD}")(gold)
query("p11_index_sizes", f"WITH {_FIXED} SELECT lang AS base, count(*) AS chunks, round(avg(length(ch.text)), 6) AS mean_chars, max(length(ch.text))::INT AS longest FROM ch JOIN documents ON doc_id = doc GROUP BY lang")(
    lambda s, d: metrics.index_sizes(chunking.fixed(f.docs(s, d)).hint("merge").join(f.docs(s, d).select("doc", "base"), "doc"), ["base"]).withColumn("mean_chars", F.round("mean_chars", 6))
)
query("p11_evidence_coverage", f"WITH {_CONTEXT} SELECT qid, hop FROM ma GROUP BY ALL HAVING NOT bool_or(found)")(
    lambda s, d: metrics.evidence_matches(_evidence(s, d), _contexts(s, d), fuzzy=False).groupBy("qid", "hop").agg(F.bool_or("found").alias("f")).where("not f").drop("f")
)
_F1 = "CASE WHEN sh = 0 THEN 0.0 ELSE 2 * (sh / na) * (sh / nr) / (sh / na + sh / nr) END"
query("e11_rouge_l", f"""WITH RECURSIVE {f.TURN_SQL}, t AS MATERIALIZED (SELECT id, {words_sql('answer')} AS a, {words_sql('reference')} AS r FROM tn WHERE answer IS NOT NULL AND reference IS NOT NULL),
l AS (SELECT id, 0 AS i, list_transform(a, lambda x: 0) AS best FROM t UNION ALL SELECT id, i + 1, list_transform(range(1, len(step) + 1), lambda j: list_max(step[1:j])) FROM (
  SELECT t.id, i, list_transform(range(1, len(a) + 1), lambda j: CASE WHEN a[j] = r[i + 1] THEN coalesce(best[j - 1], 0) + 1 ELSE best[j] END) AS step FROM l JOIN t ON t.id = l.id WHERE i < len(r))),
k AS (SELECT l.id, coalesce(list_max(best), 0) AS sh, len(a) AS na, len(r) AS nr FROM l JOIN t ON t.id = l.id WHERE i = len(r))
SELECT id, round({_F1}, 6) AS rouge_l FROM k""")(lambda s, d: metrics.rouge_l(f.turns(s, d)).withColumn("rouge_l", F.round("rouge_l", 6)))
query("e12_token_f1", f"""WITH {f.TURN_SQL}, b AS (SELECT id, {pt_tokens_sql('answer')} AS a, {pt_tokens_sql('reference')} AS r FROM tn WHERE answer IS NOT NULL AND reference IS NOT NULL),
x AS (SELECT id, x, sum(ca) AS ca, sum(cr) AS cr FROM (SELECT id, unnest(a) AS x, 1 AS ca, 0 AS cr FROM b UNION ALL SELECT id, unnest(r), 0, 1 FROM b) GROUP BY ALL),
o AS (SELECT id, sum(least(ca, cr)) AS sh FROM x GROUP BY id)
SELECT id, round({_F1}, 6) AS token_f1 FROM (SELECT b.id, len(a) AS na, len(r) AS nr, coalesce(sh, 0) AS sh FROM b LEFT JOIN o USING (id))""")(
    lambda s, d: metrics.token_f1(f.turns(s, d)).withColumn("token_f1", F.round("token_f1", 6))
)
query("e13_chrf", f"""WITH {f.TURN_SQL}, b AS (SELECT id, regexp_replace(answer, '\\s+', '', 'g') AS a, regexp_replace(reference, '\\s+', '', 'g') AS r FROM tn WHERE answer IS NOT NULL AND reference IS NOT NULL),
g AS (SELECT id, n, substr(a, i, n) AS x, 1 AS ca, 0 AS cr FROM (SELECT id, a, n, unnest(range(1, length(a) - n + 2)) AS i FROM b, range(1, 7) t(n) WHERE length(a) >= n)
  UNION ALL SELECT id, n, substr(r, i, n), 0, 1 FROM (SELECT id, r, n, unnest(range(1, length(r) - n + 2)) AS i FROM b, range(1, 7) t(n) WHERE length(r) >= n)),
c AS (SELECT id, n, x, sum(ca) AS ca, sum(cr) AS cr FROM g GROUP BY ALL),
o AS (SELECT id, n, sum(least(ca, cr)) AS sh, sum(ca) AS na, sum(cr) AS nr FROM c GROUP BY ALL),
m AS (SELECT b.id, avg(sh / na) FILTER (na > 0 AND nr > 0) AS p, avg(sh / nr) FILTER (na > 0 AND nr > 0) AS q FROM b LEFT JOIN o USING (id) GROUP BY b.id)
SELECT id, round(CASE WHEN coalesce(p + q, 0) = 0 THEN 0 ELSE 5 * p * q / (4 * p + q) END, 6) AS chrf FROM m""")(
    lambda s, d: metrics.chrf(f.turns(s, d)).withColumn("chrf", F.round("chrf", 6))
)


def _samples(s, d):
    """Assistant turns with the user's turn as question, the next turn as reference and both as contexts."""
    t = f.turns(s, d)
    return t.select("id", F.col("reference").alias("question"), "answer", F.concat_ws(" ", "reference", "answer").alias("reference"), F.array("reference", "answer").alias("contexts"))


_PLACE = "(('0x' || substr(md5(w), 1, 7))::BIGINT % 128)"
query("e1_e5_embedding_metrics", f"""WITH {f.TURN_SQL}, tx AS (SELECT id, unnest([{{'k': 'q', 't': reference}}, {{'k': 'a', 't': answer}}, {{'k': 'r', 't': concat_ws(' ', reference, answer)}}]) AS x FROM tn),
w AS (SELECT id, x.k AS k, unnest({words_sql('x.t')}) AS w FROM tx),
v AS (SELECT id, k, {_PLACE} % 64 AS place, sum(CASE WHEN {_PLACE} < 64 THEN 1 ELSE -1 END)::DOUBLE AS v FROM w GROUP BY ALL),
n AS (SELECT id, k, sqrt(sum(v * v)) AS n FROM v GROUP BY ALL),
dt AS (SELECT a.id, a.k AS k1, b.k AS k2, sum(a.v * b.v) AS dot FROM v a JOIN v b USING (id, place) GROUP BY ALL),
cs AS (SELECT dt.id, k1, k2, greatest(0, CASE WHEN x.n * y.n = 0 THEN 0 ELSE dot / (x.n * y.n) END) AS c FROM dt JOIN n x ON x.id = dt.id AND x.k = k1 JOIN n y ON y.id = dt.id AND y.k = k2),
z AS (SELECT tn.id, k1, k2, coalesce(c, 0) AS c FROM tn CROSS JOIN (SELECT * FROM (VALUES ('a', 'q'), ('a', 'r'), ('r', 'r'), ('q', 'q'), ('q', 'a')) t(k1, k2)) LEFT JOIN cs USING (id, k1, k2))
SELECT id, round(max(c) FILTER (k1 = 'a' AND k2 = 'q'), 6) AS answer_relevancy, round(max(c) FILTER (k1 = 'a' AND k2 = 'r'), 6) AS faithfulness,
  round((max(c) FILTER (k1 = 'q' AND k2 = 'q') + max(c) FILTER (k1 = 'q' AND k2 = 'a')) / 2, 6) AS context_precision,
  round(max(c) FILTER (k1 = 'r' AND k2 = 'r'), 6) AS context_recall, round(max(c) FILTER (k1 = 'a' AND k2 = 'r'), 6) AS answer_correctness FROM z GROUP BY id""")(
    lambda s, d: (lambda m: m.select("id", *(F.round(c, 6).alias(c) for c in m.columns if c != "id")))(metrics.embedding_metrics(_samples(s, d)))
)
query("e14_scores_long", f"""WITH {f.RESULT_SQL} SELECT metric, count(*) AS n, round(avg(value), 6) AS mean FROM (SELECT unnest([{{'metric': 'chrf', 'value': chrf}}, {{'metric': 'context_hit', 'value': context_hit}}], recursive := true) FROM r) WHERE value IS NOT NULL GROUP BY metric""")(
    lambda s, d: metrics.as_scores(f.results(s, d).withColumnRenamed("result_id", "id"), ["chrf", "context_hit"]).groupBy("metric").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
)


def _pending(s, d):
    r = f.results(s, d).withColumnRenamed("result_id", "id")
    return metrics.pending(r, metrics.as_scores(r, ["chrf", "context_hit"]), ["chrf", "context_hit"])


query("e15_pending_scores", f"WITH {f.RESULT_SQL} SELECT result_id AS id, 'context_hit' AS metric FROM r WHERE answer NOT LIKE '[ERRO: %' AND context_hit IS NULL")(_pending)


def _facts(s, d):
    """Orders as answers that name a distance, in kilometres or not, and a number with or without it; both are their key facts."""
    o = f.table(s, d, "orders")
    answer = F.concat(F.lit("Fica a 0"), "o_custkey", F.when(F.col("o_orderkey") % 2 == 0, " quilômetros").otherwise(" minutos"), F.when(F.col("o_orderkey") % 3 > 0, F.concat(F.lit(" e é o pedido nº 00"), "o_orderkey")).otherwise(""), F.lit("."))
    return o.select(F.col("o_orderkey").alias("id"), F.explode(F.array(F.concat("o_custkey", F.lit(" km")), F.concat(F.lit("pedido "), "o_orderkey"))).alias("fact"), answer.alias("answer"))


query("e16_key_facts", """SELECT o_orderkey AS id, 2::BIGINT AS facts, h::BIGINT AS hits, ['none', 'half', 'all'][h + 1] AS leak FROM (SELECT o_orderkey, (o_orderkey % 2 = 0)::INT + (o_orderkey % 3 > 0 OR o_orderkey = o_custkey)::INT AS h FROM orders)""")(lambda s, d: metrics.leakage_class(metrics.key_facts(_facts(s, d))))

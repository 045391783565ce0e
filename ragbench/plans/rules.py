"""Queries on rules that refuse or resolve: adjudication, resumption, retests, configurations; and on retrieval through a graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ragbench.functions.vectors import hash_embedding, norm, question_vectors
from ragbench.operators import annotation as an
from ragbench.operators import dialogue as dl
from ragbench.operators import graph, grid, techniques
from ragbench.plans import frames as f
from ragbench.plans.annotation import _CO, _N, decisions, notes
from ragbench.plans.lifecycle import _unit, pick
from ragbench.plans.pipelines import _CTX, contexts
from ragbench.plans.ranking import r6

QUERIES, SQL = {}, {}


def add(name, fn, sql=None):
    QUERIES[name] = fn
    if sql:
        SQL[name] = sql


def vector_graph(s, d):
    """Vectors as entities and as relations to the vector seven ids on; chunks of ten ids and one for each label; synonyms three ids apart."""
    e = f.table(s, d, "embeddings").withColumn("v", F.transform("embedding", lambda x: x.cast("double")))
    ten = F.floor(F.col("vec_id") / 10)
    entities = e.select(F.col("vec_id").alias("key"), F.concat(F.lit("e"), "vec_id").alias("name"), F.col("v").alias("vector"), F.array_distinct(F.array(ten, F.col("label") + 100_000, ten + F.col("vec_id") % 2)).alias("chunk_ids"))
    ids = e.select((F.col("vec_id") - 7).alias("vec_id"))
    relations = e.join(ids, "vec_id", "left_semi").select(F.col("vec_id").alias("relation_id"), F.col("vec_id").alias("source"), (F.col("vec_id") + 7).alias("target"), F.concat(F.lit("d"), F.col("vec_id") % 3).alias("description"), F.reverse("v").alias("vector"), F.array(ten).alias("chunk_ids"))
    near = e.join(e.select((F.col("vec_id") - 3).alias("vec_id")), "vec_id", "left_semi").select(F.col("vec_id").alias("key"), (F.col("vec_id") + 3).alias("other"), F.lit(0.9).alias("weight"))
    chunks = entities.select(F.explode("chunk_ids").alias("chunk_id")).distinct().where("chunk_id % 7 <> 3")
    return f.vector_questions(s, d), entities, relations, near.unionByName(near.select(F.col("other").alias("key"), F.col("key").alias("other"), "weight")), chunks


_GRAPH = """e AS (SELECT vec_id AS key, embedding::DOUBLE[] AS v, list_distinct([vec_id // 10, label + 100000, vec_id // 10 + vec_id % 2]) AS cs FROM embeddings),
cn AS (SELECT DISTINCT c FROM (SELECT unnest(cs) AS c FROM e) WHERE c % 7 <> 3), nn AS (SELECT count(*) AS n FROM cn),
sp AS (SELECT key, ln((greatest(n, len(cs)) + 1) / len(cs)) / ln(greatest(n, len(cs)) + 1) AS spec FROM e, nn),
rl AS (SELECT a.key AS rid, a.key AS source, b.key AS target, 'd' || a.key % 3 AS description, list_reverse(a.v) AS v, a.key // 10 AS c FROM e a JOIN e b ON b.key = a.key + 7),
q AS (SELECT key AS qid, v AS qv FROM e WHERE key % 20 = 0),
ft AS (SELECT qid, key, score FROM (SELECT qid, key, round(list_cosine_similarity(qv, v), 9) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(list_cosine_similarity(qv, v), 9) DESC, key) AS r FROM q, e) WHERE r <= 5),
fr AS (SELECT qid, rid, r, score FROM (SELECT qid, rid, round(list_cosine_similarity(qv, v), 9) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(list_cosine_similarity(qv, v), 9) DESC, rid) AS r FROM q, rl) WHERE r <= 5),
sd AS (SELECT qid, key, score * spec AS score FROM ft JOIN sp USING (key)),
ed AS (SELECT source AS a, target AS b FROM rl UNION SELECT target, source FROM rl), sy AS (SELECT a.key, b.key AS other FROM e a JOIN e b ON abs(a.key - b.key) = 3),
rc AS (SELECT qid, b AS key, score * 0.5 AS score FROM sd JOIN ed ON key = a UNION ALL SELECT qid, other, score * 0.9 FROM sd JOIN sy USING (key)),
nd AS (SELECT qid, key, max(score) AS score FROM (SELECT * FROM sd UNION ALL SELECT qid, key, score * spec FROM rc JOIN sp USING (key)) GROUP BY ALL)"""
add("t10_graph_contexts", lambda s, d: r6(graph.graph_retrieve(*vector_graph(s, d))[0], "score"), f"""WITH {_GRAPH}, pt AS (SELECT qid, unnest(cs) AS c, score FROM nd JOIN e USING (key)
  UNION ALL SELECT qid, c, fr.score * sqrt(a.spec * b.spec) FROM fr JOIN rl USING (rid) JOIN sp a ON a.key = source JOIN sp b ON b.key = target),
tt AS (SELECT qid, c, sum(score) AS score FROM pt WHERE c IN (SELECT c FROM cn) GROUP BY ALL HAVING sum(score) > 0)
SELECT qid, rank, c AS chunk_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, c)::INT AS rank FROM tt) WHERE rank <= 5""")
add("t10_graph_facts", lambda s, d: graph.graph_retrieve(*vector_graph(s, d))[1], f"""WITH {_GRAPH}, tx AS (SELECT *, source || ' → ' || target || ': ' || description AS text FROM rl),
ca AS (SELECT qid, 0 AS k, r AS n, text FROM fr JOIN tx USING (rid) UNION ALL SELECT qid, 1, rid, text FROM sd JOIN tx ON key = source OR key = target),
fi AS (SELECT qid, text, min(k * 1000000000 + n) AS pos FROM ca GROUP BY ALL), ru AS (SELECT qid, text, row_number() OVER w AS n, sum(length(text)) OVER (PARTITION BY qid ORDER BY pos, text) AS chars FROM fi WINDOW w AS (PARTITION BY qid ORDER BY pos, text))
SELECT qid, n::INT AS n, text FROM ru WHERE n <= 10 AND chars <= 2000""")
add("t10_graph_entities", lambda s, d: r6(graph.graph_retrieve(*vector_graph(s, d))[2], "score"), f"""WITH {_GRAPH}, x AS (SELECT nd.qid, 'e' || nd.key AS name, nd.score, CASE WHEN sd.key IS NULL THEN 1 ELSE 0 END AS hop FROM nd LEFT JOIN sd ON sd.qid = nd.qid AND sd.key = nd.key),
y AS (SELECT *, row_number() OVER (PARTITION BY qid, hop ORDER BY round(score, 9) DESC, name) AS n FROM x)
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY hop, round(score, 9) DESC, name)::INT AS place, name, round(score, 6) AS score, hop FROM y WHERE hop = 0 OR n <= 20""")


def graph_prompts(s, d):
    """A conversation's first passages as the context, its system texts as facts."""
    c = contexts(s, d)
    return graph.graph_context(techniques.context_block(c.where("rank <= 2")), c.where("rank > 2 and qid % 2 = 0").select("qid", F.col("rank").alias("n"), "text")).select("qid", F.sha2("context", 256).alias("digest"))


add("t10_graph_prompts", graph_prompts, f"""WITH {_CTX} SELECT qid, sha256(string_agg(text, chr(10) || chr(10) ORDER BY rank) FILTER (rank <= 2) || CASE WHEN qid % 2 = 0 AND max(rank) > 2 THEN chr(10) || chr(10) || 'Fatos do Grafo de conhecimento:' || chr(10) || string_agg('- ' || text, chr(10) ORDER BY rank) FILTER (rank > 2) ELSE '' END) AS digest FROM ctx GROUP BY qid""")
add("t8_compressed_blocks", lambda s, d: techniques.compressed_blocks(contexts(s, d).where("rank = 1"), contexts(s, d).where("qid % 2 = 1"), contexts(s, d).where("rank = 1").select("qid", F.concat(F.lit(" "), F.substring("text", 1, 30)).alias("extract"))),
    f"WITH {_CTX} SELECT qid, CASE WHEN qid % 2 = 1 THEN trim(' ' || substr(text, 1, 30), ' ') ELSE '' END AS context FROM ctx WHERE rank = 1")


def vectors_ahead(s, d):
    q = f.table(s, d, "benchmark").select("text")
    return question_vectors(q, {"e5": hash_embedding, "plain": hash_embedding}).select("embedding", F.sha2("text", 256).alias("digest"), norm(F.col("vector")).alias("size"))


add("v6_question_vectors", lambda s, d: r6(vectors_ahead(s, d), "size"), f"""WITH p AS (SELECT DISTINCT unnest(['e5', 'plain']) AS embedding, text AS t FROM benchmark WHERE text IS NOT NULL), r AS (SELECT embedding || '|' || sha256(t) AS id, CASE WHEN embedding = 'e5' THEN 'query: ' || t ELSE t END AS text FROM p), u AS ({_unit('r', 'id')})
SELECT split_part(k, '|', 1) AS embedding, split_part(k, '|', 2) AS digest, round(sqrt(sum(v * v)), 6) AS size FROM u GROUP BY k""")


def extractors(s, d):
    e = f.table(s, d, "events").select(F.col("event_type").alias("extractor"), (F.col("user_id") % 10).alias("index"))
    return e.select("index").distinct(), e.where("extractor = 'error' or index < 5")


for no, (wanted, sql) in enumerate((
    (None, "SELECT CASE WHEN len(c) = 1 THEN c[1] END AS extractor, CASE WHEN len(c) > 1 THEN 'several extractors fit: ' || array_to_string(c, ', ') WHEN len(c) = 0 THEN 'the indexes have graphs of different extractors' END AS error FROM (SELECT coalesce(list_sort(list(event_type)), []) AS c FROM (SELECT event_type FROM g GROUP BY 1 HAVING count(DISTINCT i) = 10))"),
    ("purchase", "SELECT CASE WHEN len(m) = 0 THEN 'purchase' END AS extractor, CASE WHEN len(m) > 0 THEN 'no current graph of ' || array_to_string(m, ', ') END AS error FROM (SELECT coalesce(list_sort(list(i::VARCHAR)), []) AS m FROM (SELECT DISTINCT user_id % 10 AS i FROM events) WHERE i NOT IN (SELECT i FROM g WHERE event_type = 'purchase'))"),
)):
    add(("g17_chosen_extractor", "g17_wanted_extractor")[no], lambda s, d, w=wanted: graph.chosen_extractor(*extractors(s, d), w), f"WITH g AS (SELECT event_type, user_id % 10 AS i FROM events WHERE event_type = 'error' OR user_id % 10 < 5) {sql}")


def conflicts(s, d):
    """Two lists of each supplier's parts: those that its lines name, and a given one that is empty, the same or another."""
    x = f.table(s, d, "lineitem").select(F.col("l_suppkey").alias("config"), F.lit("rag").alias("dim"), F.col("l_returnflag").alias("v")).groupBy("config", "dim").agg(F.array_sort(F.collect_set("v")).alias("values"))
    given = x.withColumn("values", F.when(F.col("config") % 3 == 0, F.array().cast("array<string>")).when(F.col("config") % 3 == 1, F.col("values")).otherwise(F.array(F.lit("N"), F.lit("X"))))
    return grid.list_conflicts(given, x)


add("x2_list_conflicts", conflicts, "SELECT DISTINCT l_suppkey AS config, 'rag' AS dim FROM lineitem WHERE l_suppkey % 3 = 2")
def without_evidence(s, d):
    """Experiments that ask for evidence, of whose questions only those of one type have any."""
    r = f.results(s, d)
    asked = r.select("experiment", F.when(F.col("question_type") == "ponte", F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("evidence"))
    return grid.missing_evidence(r.select("experiment", "rag"), asked, by=("experiment",))


add("x3_missing_evidence", without_evidence,
    f"WITH {f.RESULT_SQL} SELECT DISTINCT experiment, rag, 'needs reference evidence' AS error FROM r WHERE rag = 'oracle' AND experiment NOT IN (SELECT experiment FROM r WHERE question_type = 'ponte')")


def log(s, d):
    e = f.table(s, d, "events")
    return e.select((F.col("user_id") % 40).alias("experiment"), F.col("ts").cast("timestamp").alias("ts"), "event_id", pick(("answer", "answer", "request", "pause", "resume"), F.col("event_id") % 5).alias("kind"), F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("reason"))


add("x9_pauses", lambda s, d: grid.pauses(log(s, d)).select("experiment", "no", "reason", "questions_done"), """WITH l AS (SELECT user_id % 40 AS x, ts, event_id, ['answer', 'answer', 'request', 'pause', 'resume'][event_id % 5 + 1] AS kind, CASE WHEN event_id % 3 = 0 THEN event_type END AS reason FROM events),
p AS (SELECT *, sum((kind = 'pause')::INT) OVER w - (kind = 'pause')::INT AS part, sum((kind = 'answer')::INT) OVER w AS done FROM l WINDOW w AS (PARTITION BY x ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
a AS (SELECT x, part, max({'t': ts, 'e': event_id, 'r': reason}).r AS asked FROM p WHERE kind = 'request' GROUP BY ALL)
SELECT x AS experiment, (part + 1)::BIGINT AS no, coalesce(reason, asked, 'manual') AS reason, done::BIGINT AS questions_done FROM p LEFT JOIN a USING (x, part) WHERE kind = 'pause'""")


def resumptions(s, d):
    o = f.table(s, d, "orders")
    experiments = o.select(F.col("o_orderkey").alias("experiment"), pick(("paused", "failed", "done"), F.col("o_custkey") % 3).alias("status"), (F.col("o_custkey") % 5).alias("questions"), (F.col("o_custkey") % 4 + 1).cast("int").alias("concurrency"))
    changed = f.table(s, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("experiment"))
    requests = f.table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("experiment"), F.col("l_linenumber").cast("int").alias("request")).agg(F.first(F.lit(1)).alias("x")).select(F.when(F.col("experiment") % 50 == 0, -F.col("experiment")).otherwise(F.col("experiment")).alias("experiment"), "request", F.when(F.col("request") != 2, F.col("request") % 4).alias("concurrency"))
    return grid.resumed(experiments, changed, requests)


add("x11_resumed", resumptions, """WITH e AS (SELECT o_orderkey AS x, o_custkey % 3 AS st, o_custkey % 5 AS qs, (o_custkey % 4 + 1)::INT AS cc FROM orders), ch AS (SELECT DISTINCT l_orderkey AS x FROM lineitem WHERE l_quantity > 45),
rq AS (SELECT DISTINCT CASE WHEN l_orderkey % 50 = 0 THEN -l_orderkey ELSE l_orderkey END AS x, l_linenumber::INT AS request, CASE WHEN l_linenumber <> 2 THEN (l_linenumber % 4)::INT END AS asked FROM lineitem),
r AS (SELECT rq.x, request, asked, cc, CASE WHEN e.x IS NULL THEN 'unknown experiment' WHEN st = 2 THEN 'not paused or failed' WHEN qs = 0 THEN 'no questions recorded' WHEN ch.x IS NOT NULL THEN 'inputs have changed' WHEN asked IS NOT NULL AND NOT asked BETWEEN 1 AND cc THEN 'concurrency out of range' END AS er FROM rq LEFT JOIN e ON e.x = rq.x LEFT JOIN ch ON ch.x = rq.x),
t AS (SELECT *, CASE WHEN er IS NULL AND row_number() OVER (PARTITION BY x, er IS NULL ORDER BY request) > 1 THEN 'resumed by another request' ELSE er END AS error FROM r)
SELECT x AS experiment, request, CASE WHEN error IS NULL THEN 'pending' END AS status, CASE WHEN error IS NULL THEN coalesce(asked, cc) END AS concurrency, error FROM t""")
add("d2_rated", lambda s, d: dl.rated(f.table(s, d, "conversations").select("conv_id").distinct(), f.table(s, d, "events").select((F.col("user_id") % 60 + 1).alias("conv_id"), (F.col("event_id") % 14 - 1).cast("int").alias("rating"), F.struct("ts", "event_id").alias("rated_at"))).select("conv_id", "rating"),
    "WITH r AS (SELECT user_id % 60 + 1 AS conv_id, arg_max((event_id % 14 - 1)::INT, {'t': ts, 'e': event_id}) AS rating FROM events WHERE event_id % 14 - 1 BETWEEN 0 AND 10 GROUP BY 1) SELECT conv_id, rating FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN r USING (conv_id)")
add("d5_saved_configurations", lambda s, d: dl.saved_configurations(f.table(s, d, "customer").select(F.col("c_custkey").alias("config_id"), F.concat_ws("-", F.floor(F.col("c_custkey") / 4), F.lit("n")).alias("name"), F.when(F.col("c_custkey") % 4 == 0, F.col("c_custkey") + 2).alias("deleted_at"))),
    "SELECT c_custkey AS config_id, (c_custkey // 4) || '-n' AS name, c_custkey % 4 IN (0, 2) AS ok FROM customer")


def rounds(s, d):
    o = f.table(s, d, "orders")
    experiments = o.select(F.col("o_orderkey").alias("experiment"), F.when(F.col("o_orderstatus") == "F", "done").otherwise("running").alias("status"), (F.col("o_custkey") % 2).alias("base"))
    return an.pool_violations(o.select((F.col("o_custkey") - F.col("o_custkey") % 2).alias("round"), F.col("o_orderkey").alias("experiment")).where("round % 3 > 0 or experiment % 2 = 0"), experiments)


add("h1_pool_violations", rounds, """WITH x AS (SELECT o_custkey - o_custkey % 2 AS round, o_orderstatus, o_custkey % 2 AS base FROM orders WHERE (o_custkey - o_custkey % 2) % 3 > 0 OR o_orderkey % 2 = 0)
SELECT round, CASE WHEN bool_or(o_orderstatus <> 'F') THEN 'unfinished experiments' ELSE 'experiments of several bases' END AS error FROM x GROUP BY round HAVING bool_or(o_orderstatus <> 'F') OR count(DISTINCT base) > 1""")


def checked(s, d):
    """Each item is of one of four rounds; decisions come from several people and leave some dimensions out."""
    n = notes(s, d).withColumn("round", F.col("item") % 4)
    r = n.select("round").distinct().select("round", F.when(F.col("round") == 3, "ana").otherwise("zoe").alias("adjudicator"), F.when(F.col("round") == 2, "open").otherwise("closed").alias("status"))
    i = n.select("round", "item").distinct()
    who = F.when(F.col("item") % 8 == 4, "yan").when(F.col("round") == 3, "ana").otherwise("zoe")
    made = i.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1)))).select((F.col("item") * 2 + F.col("k")).alias("decision"), "round", "item", who.alias("adjudicator"))
    made = made.withColumn("correctness", F.when(F.col("decision") % 5 > 0, (F.col("decision") % 3).cast("int"))).withColumn("grounding", F.when(F.col("decision") % 7 > 3, F.lit(1)))
    return an.adjudication_violation(made, r, n)


_CHECKED = f"""WITH {_N}, nr AS (SELECT *, item % 4 AS round FROM nt), dp AS (SELECT round, item, list_sort(list(dim)) AS disputed FROM (SELECT round, item, dim FROM nr WHERE score IS NOT NULL GROUP BY ALL HAVING count(DISTINCT score) > 1) GROUP BY ALL),
i AS (SELECT DISTINCT round, item FROM nr), md AS (SELECT item * 2 + unnest([0, 1]) AS decision, round, item, CASE WHEN item % 8 = 4 THEN 'yan' WHEN round = 3 THEN 'ana' ELSE 'zoe' END AS adjudicator FROM i),
me AS (SELECT *, CASE WHEN decision % 5 > 0 THEN (decision % 3)::INT END AS correctness, CASE WHEN decision % 7 > 3 THEN 1 END AS grounding FROM md),
ck AS (SELECT me.*, disputed, CASE WHEN item % 8 = 4 THEN 'not the adjudicator' WHEN round = 2 THEN 'round not closed' WHEN adjudicator = 'ana' THEN 'adjudicator scored in the round' WHEN disputed IS NULL THEN 'nothing disputed'
  WHEN (list_contains(disputed, 'correctness') AND correctness IS NULL) OR (list_contains(disputed, 'grounding') AND grounding IS NULL) THEN 'undecided: ' || concat_ws(', ', CASE WHEN list_contains(disputed, 'correctness') AND correctness IS NULL THEN 'correctness' END, CASE WHEN list_contains(disputed, 'grounding') AND grounding IS NULL THEN 'grounding' END) END AS violation
  FROM me LEFT JOIN dp USING (round, item))"""
add("h14_adjudication_rules", lambda s, d: checked(s, d).select("decision", "violation"), f"{_CHECKED} SELECT decision, violation FROM ck")
add("h14_decided", lambda s, d: an.decided(checked(s, d)), f"""{_CHECKED}, ls AS (SELECT * FROM ck WHERE violation IS NULL QUALIFY row_number() OVER (PARTITION BY round, item ORDER BY decision DESC) = 1)
SELECT round, item, dim, score FROM (SELECT round, item, disputed, 'correctness' AS dim, correctness AS score FROM ls UNION ALL SELECT round, item, disputed, 'grounding', grounding FROM ls) WHERE list_contains(disputed, dim)""")


def validated(s, d):
    final = an.final_notes(notes(s, d), decisions(s, d), f.table(s, d, "labels").select(F.col("doc_id").alias("item")).distinct()).where("dim = 'correctness'")
    docs = f.table(s, d, "documents").select(F.col("doc_id").alias("item"), "lang", F.when(F.col("doc_id") % 6 > 0, F.col("n_chars") % 100 / 100).alias("automatic"))
    return final.join(docs, "item").select("item", "lang", F.col("final").alias("human"), "automatic")


add("h16_group_means", lambda s, d: r6(an.group_means(validated(s, d), ["lang"]), "human", "automatic"), f"""WITH {_N}, v AS (SELECT item, dim, count(DISTINCT score) AS k, min(score) AS common, max(score) AS top FROM nt WHERE score IS NOT NULL GROUP BY ALL),
fi AS (SELECT item, CASE WHEN k > 1 THEN CASE WHEN item % 2 = 0 THEN top END ELSE common END AS human FROM v WHERE dim = 'correctness')
SELECT lang, count(*) AS n, round(avg(human), 6) AS human, round(avg((n_chars % 100) / 100), 6) AS automatic FROM fi JOIN documents ON doc_id = item WHERE human IS NOT NULL AND doc_id % 6 > 0 GROUP BY lang""")
add("h16_rho_interval", lambda s, d: r6(an.spearman_interval(validated(s, d), ["lang"], "human", "automatic"), "low", "high"))  # random draws are not SQL


def passes(s, d):
    second = notes(s, d).withColumn("score", F.when(F.col("item") % 9 == 0, 1 - F.col("score")).when(F.col("item") % 11 > 0, F.col("score")))
    return an.two_passes(notes(s, d), second, "ana")


add("h17_retest_alpha", lambda s, d: r6(an.krippendorff(passes(s, d), ["dim"], "ordinal"), "alpha"), _CO.replace("v AS (SELECT dim, item, score, count(*) AS c FROM nt WHERE", "ps AS (SELECT item, dim, score FROM nt WHERE annotator = 'ana' UNION ALL SELECT item, dim, CASE WHEN item % 9 = 0 THEN 1 - score WHEN item % 11 > 0 THEN score END FROM nt WHERE annotator = 'ana'),\nv AS (SELECT dim, item, score, count(*) AS c FROM ps WHERE", 1)
    + " SELECT dim, round(1 - sum(w * gap ** 2) / (sum(fa * fb * gap ** 2) / (any_value(n) - 1)), 6) AS alpha FROM gd GROUP BY dim")
add("h17_retest_round", lambda s, d: an.retest(f.table(s, d, "labels").select(F.col("doc_id").alias("item")).distinct(), "ana", 9), "SELECT doc_id AS source_item, 'ana' AS annotator, row_number() OVER (ORDER BY md5(concat_ws('|', 9, 'ana', doc_id)), doc_id)::INT AS position FROM (SELECT DISTINCT doc_id FROM labels)")


def preferences(s, d):
    """Two raters' blind preferences between two answers to a part's question."""
    p = f.table(s, d, "part")
    side = lambda k: pick(("A", "tie", "B"), (F.col("p_size") + k) % 3)
    one = p.select(F.col("p_partkey").alias("item"), F.lit("ana").alias("annotator"), side(0).alias("preference"), (F.col("p_partkey") % 13 == 0).alias("cannot"))
    two = p.select(F.col("p_partkey").alias("item"), F.lit("bia").alias("annotator"), side(F.when(F.col("p_partkey") % 4 == 0, 1).otherwise(0)).alias("preference"), F.lit(False).alias("cannot"))
    return an.preference_scores(one.unionByName(two))


_PREF = "pf AS (SELECT p_partkey AS item, CASE WHEN p_partkey % 13 > 0 THEN p_size % 3 END AS x, (p_size + (p_partkey % 4 = 0)::INT) % 3 AS y FROM part)"
add("h19_pair_alpha", lambda s, d: r6(an.krippendorff(preferences(s, d), ["dim"], "ordinal"), "alpha"), _CO.replace(f"WITH {_N}, v AS (SELECT dim, item, score, count(*) AS c FROM nt WHERE", f"WITH {_PREF}, ps AS (SELECT 'preference' AS dim, item, x AS score FROM pf UNION ALL SELECT 'preference', item, y FROM pf), v AS (SELECT dim, item, score, count(*) AS c FROM ps WHERE", 1)
    + " SELECT dim, round(1 - sum(w * gap ** 2) / (sum(fa * fb * gap ** 2) / (any_value(n) - 1)), 6) AS alpha FROM gd GROUP BY dim")


def both_raters(s, d):
    x = preferences(s, d)
    return x.groupBy("item", "dim").agg(F.max(F.when(F.col("annotator") == "ana", F.col("score"))).alias("x"), F.max(F.when(F.col("annotator") == "bia", F.col("score"))).alias("y"))


add("h19_pair_kappa", lambda s, d: r6(an.kappa(both_raters(s, d), ["dim"], "linear"), "kappa"), f"""WITH {_PREF}, c AS (SELECT x, y, count(*) AS n FROM pf WHERE x IS NOT NULL GROUP BY ALL), a AS (SELECT x, sum(n) AS nx FROM c GROUP BY x), b AS (SELECT y, sum(n) AS ny FROM c GROUP BY y), t AS (SELECT sum(n) AS t FROM c)
SELECT 'preference' AS dim, round(1 - (SELECT sum(abs(x - y) * n) FROM c) / t / (SELECT sum(abs(x - y) * nx * ny) FROM a, b) * t * t, 6) + 0 AS kappa FROM t""")

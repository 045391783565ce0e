"""Queries on graphs, techniques, clean-up, catalogues and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ragbench.functions.text import name_key, normal_words_sql
from ragbench.operators import graph as gr
from ragbench.operators import prep
from ragbench.operators import retrieval as re_
from ragbench.operators import techniques as te
from ragbench.plans import frames as f
from ragbench.plans.ranking import r6, scores
from ragbench.sources import tables as st
from ragbench.sources.shared import shared_place
from ragbench.streaming import jobs

QUERIES, SQL = {}, {}


def add(name, fn, sql=None):
    QUERIES[name] = fn
    if sql:
        SQL[name] = sql


def replies(s, d):
    """Each supplier as a chunk whose extraction names it, its nation and region, with a broken line now and then."""
    x = f.table(s, d, "supplier").join(f.table(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(f.table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    lines = F.array(
        F.concat(F.lit("1. entidade<|>"), "s_name", F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit(" (S"), "s_suppkey", F.lit(")"))).otherwise(""), F.lit("<|>Organização<|>saldo "), F.round("s_acctbal").cast("int").cast("string")),
        F.concat(F.lit("(entidade<|>"), F.initcap("n_name"), F.lit("<|>Lugar<|>"), "r_name", F.lit(")")), F.concat(F.lit("- relacao<|>"), "s_name", F.lit("<|>"), "n_name", F.lit("<|>sede<|>fica em "), "n_name"),
        F.concat(F.lit("relacao<|>"), "n_name", F.lit("<|>"), "r_name", F.lit("<|>parte<|>faz parte")), F.when(F.col("s_suppkey") % 5 == 0, F.lit("linha sem forma")).otherwise("<|FIM|>"),
    )
    return x.select(F.col("s_suppkey").alias("chunk_id"), F.array_join(lines, "\n").alias("reply"))


def lines(s, d):
    return gr.parse_replies(replies(s, d))


_SRC = "z AS (SELECT s_suppkey, s_name, n_name, r_name, round(s_acctbal)::INT AS bal FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
_LINES = f"""WITH {_SRC}, ln AS (
SELECT s_suppkey AS chunk_id, 0 AS line_no, 'entity' AS kind, s_name || CASE WHEN s_suppkey % 3 = 0 THEN ' (S' || s_suppkey || ')' ELSE '' END AS a, NULL AS b, 'organizacao' AS type, NULL AS keywords, 'saldo ' || bal AS description FROM z
UNION ALL SELECT s_suppkey, 1, 'entity', array_to_string(list_transform(string_split(lower(n_name), ' '), lambda w: upper(w[1]) || w[2:]), ' '), NULL, 'lugar', NULL, r_name FROM z
UNION ALL SELECT s_suppkey, 2, 'relation', s_name, n_name, NULL, 'sede', 'fica em ' || n_name FROM z UNION ALL SELECT s_suppkey, 3, 'relation', n_name, r_name, NULL, 'parte', 'faz parte' FROM z
UNION ALL SELECT s_suppkey, 4, 'failed', NULL, NULL, NULL, NULL, NULL FROM z WHERE s_suppkey % 5 = 0)"""
add("g2_parse_replies", lines, f"{_LINES} SELECT * FROM ln")
add("g1_without_headings", lambda s, d: f.docs(s, d).where("text is not null").select("doc", F.sha2(gr.without_headings(F.concat(F.lit("# A\n\n## B\n"), "text")), 256).alias("digest")),
    "SELECT doc_id AS doc, sha256(trim(regexp_replace(text, '^(\\s*\\n)+', ''), ' ')) AS digest FROM documents WHERE text IS NOT NULL")
add("g3_missing_extractions", lambda s, d: gr.missing_extractions(f.docs(s, d).select("doc", F.coalesce("text", F.lit("")).alias("body"), gr.extraction_key(F.lit("m"), F.lit("v1"), F.coalesce("text", F.lit(""))).alias("key")), f.docs(s, d).where("base = 'en'").select(gr.extraction_key(F.lit("m"), F.lit("v1"), F.coalesce("text", F.lit(""))).alias("key"))).select("doc"),
    "SELECT doc_id AS doc FROM documents WHERE trim(text) <> '' AND text NOT IN (SELECT text FROM documents WHERE lang = 'en' AND text IS NOT NULL)")
add("g4_g7_entities", lambda s, d: gr.merge_entities(lines(s, d)).select("key", "name", "type", F.size("chunk_ids").alias("chunks"), F.array_join("aliases", ",").alias("aliases"), F.length("description").alias("description_length")),
    f"""WITH {_SRC} SELECT lower(s_name) AS key, s_name AS name, 'organizacao' AS type, 1 AS chunks, CASE WHEN s_suppkey % 3 = 0 THEN 'S' || s_suppkey ELSE '' END AS aliases, length('saldo ' || bal)::INT AS description_length FROM z
UNION ALL SELECT lower(n_name), array_to_string(list_transform(string_split(lower(n_name), ' '), lambda w: upper(w[1]) || w[2:]), ' '), 'lugar', count(*)::INT, '', length(r_name)::INT FROM z GROUP BY n_name, r_name""")
add("g7_relations", lambda s, d: gr.merge_relations(lines(s, d), gr.merge_entities(lines(s, d)))[0].select("source", "target", "keywords", "description", F.size("chunk_ids").alias("chunks")),
    f"""WITH {_SRC} SELECT lower(s_name) AS source, lower(n_name) AS target, 'sede' AS keywords, 'fica em ' || n_name AS description, 1 AS chunks FROM z
UNION ALL SELECT lower(n_name), lower(r_name), 'parte', 'faz parte', count(*)::INT FROM z GROUP BY n_name, r_name""")
add("g7_promoted", lambda s, d: gr.merge_relations(lines(s, d), gr.merge_entities(lines(s, d)))[1].select("key", "name", "type", F.size("chunk_ids").alias("chunks")),
    f"WITH {_SRC} SELECT lower(r_name) AS key, r_name AS name, 'outro' AS type, count(*)::INT AS chunks FROM z GROUP BY r_name")


def some_replies(s, d):
    """The replies, where the model call of every seventh chunk failed."""
    return replies(s, d).withColumn("reply", F.when(F.col("chunk_id") % 7 > 0, F.col("reply")))


def build_stats(s, d):
    found = gr.parse_replies(some_replies(s, d))
    entities = gr.merge_entities(found)
    return gr.build_stats(found, some_replies(s, d), entities, gr.merge_relations(found, entities)[0])


add("g9_build_stats", build_stats, f"""{_LINES}, k AS (SELECT * FROM ln WHERE chunk_id % 7 > 0), y AS (SELECT * FROM z WHERE s_suppkey % 7 > 0)
SELECT (SELECT count(*) FROM y) + (SELECT count(DISTINCT n_name) FROM y) AS entities, (SELECT count(*) FROM y) + (SELECT count(DISTINCT n_name) FROM y) AS relations, (SELECT count(*) FROM z) AS chunks,
  (SELECT count(*) FROM k) AS lines, (SELECT count(*) FROM k WHERE kind = 'failed') AS failed_lines, (SELECT count(*) FROM z WHERE s_suppkey % 7 = 0) AS failed_chunks, NULL AS error""")


def caching(s, d):
    chunks = replies(s, d).select("chunk_id", F.when(F.col("chunk_id") % 4 == 0, " ").otherwise(F.concat(F.lit("c"), (F.col("chunk_id") - F.col("chunk_id") % 2).cast("string"))).alias("body"))
    chunks = chunks.withColumn("key", gr.extraction_key(F.lit("m"), F.lit("v1"), F.col("body")))
    return gr.to_cache(chunks, some_replies(s, d), chunks.where("chunk_id % 10 = 1").select("key"))


add("g3_to_cache", lambda s, d: caching(s, d).select("key", F.size("lines").alias("lines")), f"""{_LINES}, c AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 = 0 THEN ' ' ELSE 'c' || (s_suppkey - s_suppkey % 2) END AS body FROM z),
h AS (SELECT id, body, sha256('v1' || chr(0) || 'm' || chr(0) || body) AS key FROM c), o AS (SELECT key, min(id) AS id, any_value(trim(body) = '') AS e FROM h WHERE (trim(body) = '' OR id % 7 > 0) AND key NOT IN (SELECT key FROM h WHERE id % 10 = 1) GROUP BY key)
SELECT key, CASE WHEN e THEN 0 ELSE (SELECT count(*) FROM ln WHERE chunk_id = id) END::INT AS lines FROM o""")


def named(s, d):
    """Names: the whole short sentences of all documents."""
    return f.short_sentences(s, d).select(name_key(F.col("name")).alias("key"), "name").groupBy("key").agg(F.min("name").alias("name"))


add("g8_synonyms", lambda s, d: gr.synonyms(named(s, d)))


def parts(s, d):
    """Parts as entities, orders as chunks: a graph whose relations join parts of one supplier's order line."""
    li = f.table(s, d, "lineitem")
    ents = li.groupBy(F.col("l_partkey").alias("key")).agg(F.array_sort(F.collect_set("l_orderkey")).alias("chunk_ids"))
    rels = li.select((F.col("l_partkey")).alias("source"), (F.col("l_suppkey") + 1).alias("target")).distinct()
    return gr.specificity(ents, f.table(s, d, "orders").count()), rels


_SPEC = "e AS (SELECT l_partkey AS key, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY l_partkey), sp AS (SELECT key, n, ln((greatest((SELECT count(*) FROM orders), n) + 1) / n) / ln(greatest((SELECT count(*) FROM orders), n) + 1) AS spec FROM e)"
add("g10_specificity", lambda s, d: r6(parts(s, d)[0].select("key", "specificity"), "specificity"), f"WITH {_SPEC} SELECT key, round(spec, 6) AS specificity FROM sp")


def nodes(s, d):
    ents, rels = parts(s, d)
    seeds = f.table(s, d, "part").where("p_size < 4").select((F.col("p_partkey") % 50).alias("qid"), F.col("p_partkey").alias("key"), (F.col("p_size") / 4.0).alias("w")).join(ents.select("key", "specificity"), "key").select("qid", "key", (F.col("w") * F.col("specificity")).alias("score"))
    links = f.table(s, d, "part").select(F.col("p_partkey").alias("key"), (F.col("p_partkey") + 7).alias("other"), F.lit(0.9).alias("weight"))
    return gr.expand(seeds, rels, links, ents), ents


_NODES = f"""WITH {_SPEC}, sd AS (SELECT p_partkey % 50 AS qid, key, p_size / 4 * spec AS score FROM part JOIN sp ON key = p_partkey WHERE p_size < 4),
ed AS (SELECT l_partkey AS a, l_suppkey + 1 AS b FROM lineitem UNION SELECT l_suppkey + 1, l_partkey FROM lineitem),
nr AS (SELECT qid, b AS key, score * 0.5 AS score FROM sd JOIN ed ON key = a UNION ALL SELECT qid, p_partkey + 7, score * 0.9 FROM sd JOIN part ON key = p_partkey),
nd AS (SELECT qid, key, max(score) AS score FROM (SELECT qid, key, score FROM sd UNION ALL SELECT qid, nr.key, score * coalesce(spec, 0) FROM nr LEFT JOIN sp USING (key)) GROUP BY ALL)"""
add("g11_expand", lambda s, d: r6(nodes(s, d)[0], "score"), f"{_NODES} SELECT qid, key, round(score, 6) AS score FROM nd")
def mentions(s, d):
    return f.table(s, d, "lineitem").select(F.col("l_partkey").alias("key"), F.col("l_orderkey").alias("chunk_id")).distinct()


add("g12_score_chunks", lambda s, d: r6(gr.score_chunks(nodes(s, d)[0], mentions(s, d), existing=f.table(s, d, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("chunk_id"))), "score"),
    f"""{_NODES}, ck AS (SELECT DISTINCT l_partkey AS key, l_orderkey AS chunk_id FROM lineitem), t AS (SELECT qid, chunk_id, sum(score) AS score FROM nd JOIN ck USING (key) WHERE chunk_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') GROUP BY ALL HAVING sum(score) > 0)
SELECT qid, chunk_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_id)::INT AS rank FROM t) WHERE rank <= 5""")
add("g13_facts", lambda s, d: gr.facts(f.table(s, d, "conversations").select(F.col("conv_id").alias("qid"), F.col("turn").alias("pos"), "text")).select("qid", "n", F.length("text").alias("chars")),
    """WITH a AS (SELECT conv_id AS qid, text, min(turn) AS pos FROM conversations GROUP BY ALL), b AS (SELECT qid, text, row_number() OVER w AS n, sum(length(text)) OVER (PARTITION BY qid ORDER BY pos, text) AS c FROM a WINDOW w AS (PARTITION BY qid ORDER BY pos, text))
SELECT qid, n::INT AS n, length(text)::INT AS chars FROM b WHERE n <= 10 AND c <= 2000""")


def gate(s, d):
    """The nations of suppliers by region, as names found and as the answer key; each side spells some names otherwise."""
    x = f.table(s, d, "nation").join(f.table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).join(f.table(s, d, "supplier").select("s_nationkey").distinct(), F.col("n_nationkey") == F.col("s_nationkey"), "left_semi")
    x = x.select(F.col("r_name").alias("section"), F.col("n_nationkey").alias("k"), F.initcap("n_name").alias("name"))
    spelt = lambda c: F.when(F.col("k") % 3 == 0, F.concat(c, F.lit(" (nation)"))).when(F.col("k") % 5 == 0, F.reverse(c)).otherwise(c)
    found = x.select("section", spelt(F.col("name")).alias("name"))
    relations = x.select("section", spelt(F.col("name")).alias("source"), F.when(F.col("k") % 2 == 0, F.col("section")).otherwise(F.lit("nowhere at all")).alias("target"))
    key = x.select("section", F.col("k").alias("entity"), F.array("name", F.concat(F.lit("the land of "), "name")).alias("names")).unionByName(x.select("section").distinct().select("section", F.lit(-1).alias("entity"), F.array("section").alias("names")))
    return gr.gate(found, relations, key, x.select("section", F.lit(-1).alias("a"), F.col("k").alias("b")))


add("g14_extraction_gate", lambda s, d: r6(gate(s, d), "entity_recall", "entity_precision", "relation_recall", "relation_precision"), """WITH x AS (SELECT r_name AS section, n_nationkey AS k FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey IN (SELECT s_nationkey FROM supplier)),
c AS (SELECT section, count(*) AS n, count(*) FILTER (k % 3 = 0 OR k % 5 <> 0) AS ok, count(*) FILTER ((k % 3 = 0 OR k % 5 <> 0) AND k % 2 = 0) AS rel FROM x GROUP BY section),
t AS (SELECT section, sum(n + 1)::BIGINT AS entities_gold, sum(n)::BIGINT AS relations_gold, sum(n)::BIGINT AS entities_predicted, sum(ok)::BIGINT AS entities_correct, sum(ok)::BIGINT AS entities_found, sum(n)::BIGINT AS relations_predicted, sum(rel)::BIGINT AS relations_correct, sum(rel)::BIGINT AS relations_found FROM c GROUP BY GROUPING SETS ((section), ()))
SELECT *, round(entities_found / entities_gold, 6) AS entity_recall, round(entities_correct / entities_predicted, 6) AS entity_precision, round(relations_found / relations_gold, 6) AS relation_recall, round(relations_correct / relations_predicted, 6) AS relation_precision, entities_found / entities_gold >= 0.6 AS passed FROM t""")


def explained(s, d):
    """The first sentences of a dialogue's user turns are the names that a graph found; in small letters, some with a word more, they are its bridge entities."""
    first = F.element_at(F.split("text", r"[.!?\n]"), 1)
    bridge = F.when(F.length(first) % 2 == 0, F.lower(first)).otherwise(F.concat(F.lower(first), F.lit(" x")))
    x = f.table(s, d, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.collect_list(first).alias("names"), F.array_append(F.collect_set(bridge), F.lit("--")).alias("bridges"))
    found = gr.bridges_found(F.col("bridges"), F.when(F.col("conv_id") % 5 > 0, F.col("names")))
    return x.select(F.col("conv_id").alias("id"), F.explode(found).alias("b")).select("id", F.sha2("b.entity", 256).alias("entity"), "b.found")


_LEN = "trim(regexp_replace(strip_accents(lower({})), '[^0-9a-z]+', ' ', 'g'))"
add("g15_bridges", explained, f"""WITH u AS (SELECT conv_id AS id, regexp_split_to_array(text, '[.!?\n]')[1] AS n FROM conversations WHERE role = 'user'),
b AS (SELECT DISTINCT id, CASE WHEN length(n) % 2 = 0 THEN lower(n) ELSE lower(n) || ' x' END AS e FROM u), g AS (SELECT id, list({_LEN.format("n")}) AS ns FROM u GROUP BY id)
SELECT b.id, sha256(e) AS entity, list_contains(ns, {_LEN.format("e")}) AS found FROM b JOIN g USING (id) WHERE id % 5 > 0 AND {_LEN.format("e")} <> ''""")
add("g17_common_extractors", lambda s, d: gr.common_extractors(f.table(s, d, "events").select(F.col("event_type").alias("extractor"), (F.col("user_id") % 10).alias("index")), 10), "SELECT event_type AS extractor FROM events GROUP BY 1 HAVING count(DISTINCT user_id % 10) = 10")


def contexts(s, d):
    c = f.table(s, d, "conversations")
    return c.where("role <> 'system'").select(F.col("conv_id").alias("qid"), F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).alias("rank"), "text")


_CTX = "ctx AS (SELECT conv_id AS qid, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS rank, text FROM conversations WHERE role <> 'system')"
add("t1_prompts", lambda s, d: te.prompts(contexts(s, d).where("rank = 1").select("qid", F.col("text").alias("question")), "Contexto: {context} Pergunta: {question}", te.context_block(contexts(s, d).where("rank > 1"))).select("qid", "key"),
    f"WITH {_CTX}, b AS (SELECT qid, string_agg(text, chr(10) || chr(10) ORDER BY rank) FILTER (rank > 1) AS c, any_value(text) FILTER (rank = 1) AS q FROM ctx GROUP BY qid) SELECT qid, sha256('Contexto: ' || coalesce(c, '') || ' Pergunta: ' || q) AS key FROM b")
add("t2_t12_answers", lambda s, d: te.answers(contexts(s, d).where("rank = 1").select("qid", F.sha2("text", 256).alias("key"), F.col("text").alias("prompt")), contexts(s, d).where("rank = 1 and qid % 2 = 0").select(F.sha2("text", 256).alias("key"), F.lit("m").alias("llm"), F.col("text").alias("reply")).distinct(), "m").select("qid", "tokens"),
    f"WITH {_CTX}, k AS (SELECT DISTINCT text FROM ctx WHERE rank = 1 AND qid % 2 = 0) SELECT qid, CASE WHEN text IN (SELECT text FROM k) THEN len(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda x: x <> '')) ELSE 0 END::INT AS tokens FROM ctx WHERE rank = 1")
add("t4_oracle_contexts", lambda s, d: te.oracle_contexts(contexts(s, d).groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") % 2 == 0, F.struct("rank", "text")))), lambda x: x["text"]).alias("evidence"))).select("qid", "rank", "source", F.length("text").alias("chars")),
    f"WITH {_CTX} SELECT qid, (rank // 2)::INT AS rank, 'oracle' AS source, length(text)::INT AS chars FROM ctx WHERE rank % 2 = 0")
add("t6_rerank", lambda s, d: te.rerank(contexts(s, d), contexts(s, d).groupBy("qid").agg(F.concat_ws(", ", F.lit("2"), F.lit("0"), F.lit("99"), F.lit("2")).alias("reply"))).select("qid", "rank", F.length("text").alias("chars")),
    f"""WITH {_CTX}, n AS (SELECT qid, count(*) AS n FROM ctx GROUP BY qid), o AS (SELECT qid, unnest(list_filter([2, 0, 1], lambda x: x < n)) AS old, unnest(range(1, len(list_filter([2, 0, 1], lambda x: x < n)) + 1))::INT AS rank FROM n)
SELECT o.qid, o.rank, length(text)::INT AS chars FROM o JOIN ctx ON ctx.qid = o.qid AND ctx.rank = old + 1""")
add("t7_corrected", lambda s, d: te.corrected(contexts(s, d).where("rank <= 2"), contexts(s, d).where("rank = 1").select("qid", F.when(F.col("qid") % 3 == 0, " insuficiente: falta").otherwise("SUFICIENTE").alias("verdict")), contexts(s, d).where("rank > 2")).select("qid", "rank"),
    f"WITH {_CTX} SELECT qid, rank FROM ctx WHERE (qid % 3 = 0 AND rank > 2) OR (qid % 3 <> 0 AND rank <= 2)")
add("t8_compressed", lambda s, d: te.compressed(contexts(s, d).where("qid % 2 = 1"), contexts(s, d).where("rank = 1").select("qid", F.substring("text", 1, 30).alias("extract"))).select("qid", "rank", "text", "source"),
    f"WITH {_CTX} SELECT qid, 1 AS rank, substr(text, 1, 30) AS text, 'compression' AS source FROM ctx WHERE rank = 1 AND qid % 2 = 1")


def agent_rounds(s, d):
    c = contexts(s, d)
    out = []
    for no in (1, 2, 3):
        reply = F.when(F.col("qid") % 4 > no, F.concat(F.lit("SEARCH: q"), F.lit(str(no)))).otherwise(F.concat(F.lit("ANSWER: a"), F.lit(str(no))))
        out.append((c.where("rank = 1").select("qid", reply.alias("reply")), c.where(f"rank <= {no}")))
    return out


add("t9_agentic", lambda s, d: te.agentic(agent_rounds(s, d)),
    f"""WITH {_CTX}, q AS (SELECT qid, count(*) AS n, least(greatest(qid % 4, 1), 3) AS k FROM ctx GROUP BY qid) SELECT qid, 'a' || k AS answer, k::INT AS rounds, (CASE WHEN k > 1 THEN 1 ELSE 0 END + CASE WHEN k > 2 THEN least(n, 2) ELSE 0 END)::BIGINT AS contexts FROM q""")


def two_rankings(s, d):
    """Two searches, with texts that neighbouring chunks share."""
    text = f.vector_chunks(s, d).select("chunk_id", F.concat(F.lit("t"), F.floor(F.col("chunk_id") / 4)).alias("text"))
    near = (re_.top_k(f.vector_questions(s, d), f.vector_chunks(s, d), 5), re_.top_k(f.vector_questions(s, d), f.vector_chunks(s, d).where("doc % 2 = 0"), 5))
    return [x.hint("merge").join(text, "chunk_id") for x in near]


add("t11_united", lambda s, d: te.united(*two_rankings(s, d)).select("qid", "rank", "text", "chunk_id"), f"""WITH {f.CHUNK_SQL}, q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id % 20 = 0), sc AS (SELECT qid, chunk_id, doc, round(list_cosine_similarity(qv, vector), 9) AS score FROM q, c),
a AS (SELECT qid, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS r FROM sc), b AS (SELECT qid, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS r FROM sc WHERE doc % 2 = 0),
u AS (SELECT qid, 't' || (chunk_id // 4) AS text, arg_min(chunk_id, p) AS chunk_id, min(p) AS p FROM (SELECT qid, chunk_id, r * 2 AS p FROM a WHERE r <= 5 UNION ALL SELECT qid, chunk_id, r * 2 + 1 FROM b WHERE r <= 5) GROUP BY qid, 't' || (chunk_id // 4)) SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY p)::INT AS rank, text, chunk_id FROM u""")


def pages(s, d):
    """Documents of one source and language as the pages of a book, with a running header and page numbers."""
    n = F.row_number().over(Window.partitionBy("source", "lang").orderBy("doc_id"))
    x = f.table(s, d, "documents").where("text is not null").select(F.concat_ws("/", "source", "lang").alias("doc"), n.alias("page"), "text")
    return x.withColumn("text", F.concat(F.lit("Guia "), F.col("page").cast("string"), F.lit("\n"), "text", F.lit("\n"), F.col("page").cast("string")))


_PAGE = r"""pg AS (SELECT concat_ws('/', source, lang) AS doc, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS page, text FROM documents WHERE text IS NOT NULL),
pl AS (SELECT doc, page, unnest(range(len(x)))::INT AS line_no, unnest(x) AS raw FROM (SELECT doc, page, string_split('Guia ' || page || chr(10) || text || chr(10) || page, chr(10)) AS x FROM pg)),
li AS (SELECT * FROM (SELECT doc, page, line_no, trim(regexp_replace(raw, '\s+', ' ', 'g')) AS line FROM pl) WHERE line <> ''),
ed AS (SELECT *, row_number() OVER (PARTITION BY doc, page ORDER BY line_no) <= 2 OR row_number() OVER (PARTITION BY doc, page ORDER BY line_no DESC) <= 2 AS edge FROM li),
ru AS (SELECT doc, mask FROM (SELECT doc, regexp_replace(line, '\d', '#', 'g') AS mask, count(DISTINCT page) AS n FROM ed WHERE edge GROUP BY ALL) JOIN (SELECT doc, count(DISTINCT page) AS pages FROM li GROUP BY doc) USING (doc) WHERE n >= 0.3 * pages),
kp AS (SELECT ed.* FROM ed LEFT JOIN ru ON ru.doc = ed.doc AND edge AND mask = regexp_replace(line, '\d', '#', 'g') WHERE ru.doc IS NULL AND NOT regexp_matches(line, '^\d{1,4}$'))"""
add("p1_p3_running_lines", lambda s, d: prep.running_lines(prep.page_lines(pages(s, d))), f"WITH {_PAGE} SELECT doc, mask FROM ru")


def kept_lines(s, d):
    x = prep.page_lines(pages(s, d))
    return prep.without_running_lines(x, prep.running_lines(x))


add("p2_kept_lines", lambda s, d: kept_lines(s, d).select("doc", "page", "line_no"), f"WITH {_PAGE} SELECT doc, page::INT AS page, line_no FROM kp")


def colons(s, d):
    """The kept lines, of which every fourth becomes a label."""
    return kept_lines(s, d).withColumn("line", F.when(F.col("line_no") % 4 == 2, F.concat("line", F.lit(":"))).otherwise(F.col("line")))


add("p4_lift_labels", lambda s, d: prep.lift_labels(colons(s, d)).select("doc", "page", "line_no", F.sha2("line", 256).alias("digest")), f"""WITH {_PAGE}, co AS (SELECT doc, page, line_no, CASE WHEN line_no % 4 = 2 THEN line || ':' ELSE line END AS line FROM kp),
ll AS (SELECT *, lead(line) OVER w AS nx, lag(line) OVER w AS pv FROM co WINDOW w AS (PARTITION BY doc, page ORDER BY line_no))
SELECT doc, page::INT AS page, line_no, sha256(CASE WHEN line NOT LIKE '%:' AND nx LIKE '%:' THEN nx || ' ' || line ELSE line END) AS digest FROM ll WHERE NOT (line LIKE '%:' AND NOT coalesce(pv LIKE '%:', true))""")


def paragraphs(s, d):
    return prep.join_wrapped(kept_lines(s, d))


_PARA = _PAGE + r""", bf AS (SELECT *, lag(line) OVER (PARTITION BY doc ORDER BY page, line_no) AS prev FROM kp),
go AS (SELECT *, coalesce(regexp_matches(prev, '\p{L}-$') AND regexp_matches(line, '^\p{Ll}'), false) AS hyphen, coalesce((regexp_matches(prev, '\p{L}-$') AND regexp_matches(line, '^\p{Ll}')) OR (NOT regexp_matches(prev, '[.!?:;]$') AND regexp_matches(line, '^[^\p{Lu}\d]')), false) AS goes FROM bf),
pn AS (SELECT *, sum((NOT goes)::INT) OVER (PARTITION BY doc ORDER BY page, line_no) AS para FROM go),
pa AS (SELECT doc, para, trim(replace(string_agg(CASE WHEN hyphen THEN chr(1) ELSE ' ' END || line, '' ORDER BY page, line_no), '-' || chr(1), ''), ' ') AS text FROM pn GROUP BY doc, para)"""
add("p5_join_wrapped", lambda s, d: paragraphs(s, d).select("doc", "para", F.sha2("text", 256).alias("digest")), f"WITH {_PARA} SELECT doc, para::BIGINT AS para, sha256(text) AS digest FROM pa")
add("p6_vocabulary", lambda s, d: prep.vocabulary(f.docs(s, d)), r"SELECT lower(w) AS word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '\p{L}+')) AS w FROM documents) GROUP BY 1")
add("p6_repair_words", lambda s, d: prep.repair_words(prep.vocabulary(f.docs(s, d)).where("word like '%ti%'").select(F.expr("replace(word, 'ti', '�')").alias("word")), prep.vocabulary(f.docs(s, d))), r"""WITH v AS (SELECT lower(w) AS word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '\p{L}+')) AS w FROM documents) GROUP BY 1),
b AS (SELECT DISTINCT replace(word, 'ti', '�') AS word FROM v WHERE word LIKE '%ti%'), c AS (SELECT b.word, replace(b.word, '�', o) AS c FROM b, (SELECT unnest(['ff', 'fi', 'fl', 'ffi', 'ffl', 'ti', 'tt']) AS o))
SELECT c.word, coalesce(arg_max(c, {'n': n, 'c': c}) FILTER (n IS NOT NULL), replace(c.word, '�', 'ti')) AS fixed, bool_or(n IS NOT NULL) AS known FROM c LEFT JOIN v ON v.word = lower(c.c) GROUP BY c.word""")
add("p7_pack", lambda s, d: prep.pack(paragraphs(s, d)).groupBy("doc").agg(F.count("*").alias("blocks"), F.max(F.length("text")).alias("longest")), f"""WITH RECURSIVE {_PARA}, pi AS MATERIALIZED (SELECT doc, text, row_number() OVER (PARTITION BY doc ORDER BY para) AS i FROM pa),
rp AS (SELECT doc, i, 0 AS block, length(text) AS cur FROM pi WHERE i = 1 UNION ALL SELECT pi.doc, pi.i, CASE WHEN cur = 0 OR cur + 1 + length(text) <= 800 THEN block ELSE block + 1 END, CASE WHEN cur = 0 THEN length(text) WHEN cur + 1 + length(text) <= 800 THEN cur + 1 + length(text) ELSE length(text) END FROM rp JOIN pi ON pi.doc = rp.doc AND pi.i = rp.i + 1)
SELECT doc, count(*) AS blocks, max(n)::INT AS longest FROM (SELECT doc, block, max(cur) AS n FROM rp GROUP BY ALL) WHERE n > 0 GROUP BY doc""")
add("p9_sections", lambda s, d: prep.sections(paragraphs(s, d), r"^\p{Lu}\S*$", r"^(The|La|Le|Der|Die)([^\p{L}\p{N}]|$)").select("doc", "article_no", "heading", F.length("text").alias("chars")), f"""WITH {_PARA}, hd AS (SELECT *, last_value(CASE WHEN regexp_matches(text, '^\\p{{Lu}}\\S*$') THEN text END IGNORE NULLS) OVER w AS heading, sum(regexp_matches(text, '^(The|La|Le|Der|Die)([^\\p{{L}}\\p{{N}}]|$)')::INT) OVER w AS article_no FROM pa WINDOW w AS (PARTITION BY doc ORDER BY para ROWS UNBOUNDED PRECEDING))
SELECT doc, article_no::BIGINT AS article_no, arg_min_null(heading, para) AS heading, (sum(length(text)) + count(*) - 1)::INT AS chars FROM hd WHERE NOT regexp_matches(text, '^\\p{{Lu}}\\S*$') AND article_no > 0 GROUP BY doc, article_no""")
add("p12_multiple_matches", lambda s, d: re_.shared_shingles(f.table(s, d, "benchmark").select(F.col("item_id").alias("id"), "text"), f.docs(s, d).select(F.col("doc").alias("id"), "text"), 12).groupBy(F.col("left_id").alias("qid")).agg(F.count("*").alias("docs")).where("docs > 1"), f"""WITH r AS (SELECT DISTINCT item_id AS qid, array_to_string(t[i:i + 11], ' ') AS run FROM (SELECT item_id, t, unnest(range(1, greatest(len(t) - 11, 1) + 1)) AS i FROM (SELECT item_id, string_split({normal_words_sql('text')}, ' ') AS t FROM benchmark))),
g AS (SELECT DISTINCT doc_id, array_to_string(t[i:i + 11], ' ') AS run FROM (SELECT doc_id, t, unnest(range(1, len(t) - 11 + 1)) AS i FROM (SELECT doc_id, string_split({normal_words_sql('text')}, ' ') AS t FROM documents)))
SELECT qid, count(DISTINCT doc_id) AS docs FROM r JOIN g USING (run) GROUP BY qid HAVING count(DISTINCT doc_id) > 1""")


def evidence_blocks(s, d):
    """(qid, hop, doc, source): each half of a benchmark text as the evidence of a hop, with the documents that hold it word for word."""
    from ragbench.plans.retrieval import _evidence

    ev = _evidence(s, d).select(F.struct("qid", "hop").alias("id"), F.col("passage").alias("text"))
    docs = f.table(s, d, "documents").select(F.col("doc_id").alias("doc"), "source", "text")
    held = re_.holding(ev, docs).select("passage_id.qid", "passage_id.hop", "doc", "source")
    return ev.select("id.qid", "id.hop").join(held.hint("merge"), ["qid", "hop"], "left")


add("p12_question_audit", lambda s, d: prep.audit(evidence_blocks(s, d).withColumn("secondary", F.col("source").isin("src1", "src2"))), r"""WITH bt AS (SELECT item_id, string_split(text, ' ') AS t FROM benchmark), bh AS (SELECT item_id, t, greatest(len(t) // 2, 1) AS h FROM bt),
ev AS (SELECT item_id AS qid, 1 AS hop, array_to_string(t[1:h], ' ') AS p FROM bh UNION ALL SELECT item_id, 2, array_to_string(t[h + 1:], ' ') FROM bh),
ma AS (SELECT qid, hop, doc_id, coalesce(source, '') IN ('src1', 'src2') AS sec FROM ev LEFT JOIN documents d ON contains(trim(regexp_replace(lower(d.text), '\s+', ' ', 'g')), trim(regexp_replace(lower(p), '\s+', ' ', 'g')))),
hp AS (SELECT qid, hop, count(doc_id) AS n, list_sort(list(DISTINCT doc_id) FILTER (doc_id IS NOT NULL)) AS docs, bool_or(sec AND doc_id IS NOT NULL) AS sec FROM ma GROUP BY ALL)
SELECT qid, unnest(list_filter([CASE WHEN min(n) = 0 THEN 'unmatched evidence' END, CASE WHEN bool_or(coalesce(sec, false)) THEN 'secondary source' END, CASE WHEN min(n) > 0 AND count(DISTINCT docs) = 1 AND count(*) > 1 THEN 'hops in the same blocks' END, CASE WHEN max(n) > 2 THEN 'more than two blocks' END], lambda x: x IS NOT NULL)) AS problem FROM hp GROUP BY qid""")
add("p10_verbatim_evidence", lambda s, d: verbatim(s, d), r"""SELECT item_id AS qid, doc_id AS doc FROM benchmark b JOIN documents d ON contains(trim(regexp_replace(lower(d.text), '\s+', ' ', 'g')), trim(regexp_replace(lower(b.text), '\s+', ' ', 'g')))""")


def verbatim(s, d):
    """Benchmark passages that stand in a document word for word."""
    q = f.table(s, d, "benchmark").select(F.col("item_id").alias("id"), "text")
    return re_.holding(q, f.docs(s, d).select("doc", "text")).select(F.col("passage_id").alias("qid"), "doc")


def chunk_table(s, d):
    return f.table(s, d, "documents").select(F.coalesce("source", F.lit("_")).alias("base"), F.lit("whole").alias("chunking"), F.coalesce("lang", F.lit("_")).alias("embedding"), F.col("doc_id").alias("doc"), F.lit(0).alias("chunk_index"), "n_chars")


_CT = "ct AS (SELECT coalesce(source, '_') AS base, 'whole' AS chunking, coalesce(lang, '_') AS embedding, doc_id AS doc, n_chars FROM documents)"


def raw_questions(s, d):
    b = f.table(s, d, "benchmark")
    i = F.col("item_id")
    return b.select(F.when(i % 7 == 0, " ").otherwise(F.col("text")).alias("pergunta"), F.when(i % 2 == 0, F.concat(F.lit(" r"), i)).alias("resposta_referencia"), F.when(i % 3 > 0, F.lit("um | dois||")).alias("evidencia_referencia"),
                    F.when(i % 5 == 1, "ponte").when(i % 5 == 2, "outra").otherwise("").alias("tipo"), F.when(i % 4 == 0, "1|2").when(i % 4 == 1, "1").alias("evidencia_salto"), F.lit("x| y |").alias("entidades_ponte"))


add("s1_questions", lambda s, d: st.parse_questions(raw_questions(s, d)).select("question", "reference", "question_type", F.size("evidence").alias("passages"), F.coalesce(F.array_max(F.transform("evidence", lambda e: e["hop"])), F.lit(0)).alias("hops"), F.size("bridge_entities").alias("bridges"), "error"),
    """WITH x AS (SELECT item_id AS i, trim(text) AS q FROM benchmark WHERE item_id % 7 <> 0) SELECT q AS question, CASE WHEN i % 2 = 0 THEN 'r' || i END AS reference, CASE i % 5 WHEN 1 THEN 'ponte' WHEN 2 THEN 'outra' ELSE 'simples' END AS question_type,
CASE WHEN i % 4 < 2 AND i % 3 = 0 THEN CASE WHEN i % 4 = 0 THEN 2 ELSE 1 END WHEN i % 3 > 0 THEN 2 ELSE 0 END AS passages, CASE WHEN i % 4 = 0 THEN 2 WHEN i % 4 = 1 THEN 1 WHEN i % 3 > 0 THEN 1 ELSE 0 END AS hops, 2 AS bridges,
CASE WHEN i % 5 = 2 THEN 'unknown tipo outra' WHEN (i % 4 = 0 AND i % 3 = 0) OR i % 4 = 1 THEN 'one hop number (1, 2, ...) is needed for each passage' END AS error FROM x""")
add("s3_numbered_chunks", lambda s, d: st.numbered(chunk_table(s, d), chunk_table(s, d).where("n_chars > 5000")).select("base", "embedding", "doc", "chunk_id"),
    f"WITH {_CT}, h AS (SELECT base, embedding, count(*) AS n FROM ct WHERE n_chars > 5000 GROUP BY ALL) SELECT base, embedding, doc, row_number() OVER (PARTITION BY base, embedding ORDER BY doc) - 1 + coalesce(n, 0) AS chunk_id FROM ct LEFT JOIN h USING (base, embedding)")
add("s4_filtered_scan", lambda s, d: st.scan(f.table(s, d, "documents"), {"lang": "en"}, {"n_chars": (500, 1500)}).select("doc_id", "n_chars"), "SELECT doc_id, n_chars FROM documents WHERE lang = 'en' AND n_chars BETWEEN 500 AND 1500")


def graph_rows(s, d):
    return chunk_table(s, d).where("doc % 3 = 0").groupBy("base", "chunking", "embedding").agg(F.lit("m").alias("extractor"), F.sum("n_chars").alias("lines"), F.count("*").alias("failed"))


add("s5_catalogue", lambda s, d: st.catalogue(chunk_table(s, d), graph_rows(s, d)).select("base", "embedding", "chunks", F.col("graphs")[0]["failed_pct"].alias("failed_pct")),
    f"WITH {_CT}, g AS (SELECT base, embedding, round(100.0 * count(*) / sum(n_chars), 1)::DOUBLE AS failed_pct FROM ct WHERE doc % 3 = 0 GROUP BY ALL) SELECT base, embedding, count(*) AS chunks, any_value(failed_pct) AS failed_pct FROM ct LEFT JOIN g USING (base, embedding) GROUP BY ALL")
add("s6_index_names", lambda s, d: chunk_table(s, d).select("base", "embedding").distinct().withColumn("name", st.index_name(F.concat("base", F.lit("__x")), F.lit("fixed"), F.col("embedding"))).select("name", st.parse_index_name(F.col("name"))["base"].alias("base"), st.graph_names(F.col("name"), F.concat(F.lit("qwen/2.5:"), "embedding"))["entities"].alias("entities"), st.valid_base_name(F.col("base")).alias("valid")),
    f"WITH {_CT}, x AS (SELECT DISTINCT base, embedding, base || '__x__fixed__' || embedding AS name FROM ct) SELECT name, base || '__x' AS base, name || '__kg_ent__qwen-2.5-' || embedding || '-' || substr(sha1('qwen/2.5:' || embedding), 1, 8) AS entities, true AS valid FROM x")
add("s7_without_base", lambda s, d: st.without_base(chunk_table(s, d), "src1").groupBy("base").agg(F.count("*").alias("n")), f"WITH {_CT} SELECT base, count(*) AS n FROM ct WHERE base <> 'src1' GROUP BY base")
add("s9_results_wide", lambda s, d: r6(st.results_wide(scores(s, d).groupBy("combo", "question", "metric").agg(F.avg("value").alias("value")), ["combo", "question"]), "chrf", "context_hit", "token_f1", "media"),
    f"WITH {f.RESULT_SQL}, {f.LONG_SQL}, a AS (SELECT combo, question, metric, avg(value) AS v FROM s GROUP BY ALL) SELECT combo, question, round(max(v) FILTER (metric = 'chrf'), 6) + 0 AS chrf, round(max(v) FILTER (metric = 'context_hit'), 6) + 0 AS context_hit, round(max(v) FILTER (metric = 'token_f1'), 6) + 0 AS token_f1, round(avg(v), 6) + 0 AS media FROM a GROUP BY combo, question")


def compared(s, d):
    """Means are exact sums of decimals, so that a tie is rounded alike in whatever order rows come."""
    from ragbench.operators.comparison import compare, other_bases
    from ragbench.plans.analysis import BASE, placed

    m = placed(s, d).withColumn("value", F.col("value").cast("decimal(20,12)"))
    return st.comparison_rows(compare(m, BASE + "@0"), other_bases(m, BASE + "@0"), m.where("base = 0").groupBy("combo").agg(F.avg("value").alias("mean")))


def _s10():
    from ragbench.plans.analysis import _AT, BASE

    def six(column, n, rows=""):
        """The mean of a decimal column to six places, in whole numbers up to the last step."""
        total = f"sum(({column} * 1000000000000)::HUGEINT){rows}"
        return f"format('{{:.6f}}', sign({total}) * ((2 * abs({total}) + {n}{rows} * 1000000) // (2 * {n}{rows} * 1000000))::DOUBLE / 1000000 + 0)"

    types = ", ".join(f"CASE WHEN count(*) FILTER (question_type = '{t}') > 0 THEN {six('diff', 'count(*)', f" FILTER (question_type = '{t}')")} END AS diferenca_{t}" for t in st.QUESTION_TYPES)
    none = ", ".join(f"NULL AS diferenca_{t}" for t in st.QUESTION_TYPES)
    return f"""{_AT}, cd AS (SELECT combo, base, question, question_type, value::DECIMAL(20,12) AS value FROM ca),
df AS (SELECT o.combo, b.question_type, (o.value - b.value)::DECIMAL(20,12) AS diff FROM cd o JOIN cd b ON b.combo = '{BASE}@0' AND o.combo <> b.combo AND o.base = b.base AND o.question = b.question),
mn AS (SELECT combo, base, count(*) AS n, {six('value', 'count(*)')} AS m FROM cd GROUP BY ALL)
SELECT df.combo, count(*) AS perguntas, {six('diff', 'count(*)')} AS diferenca, {types}, 'pareado' AS pareamento, (SELECT m FROM mn WHERE mn.combo = df.combo) AS media FROM df GROUP BY df.combo
UNION ALL SELECT combo, n, NULL, {none}, 'outra Base', m FROM mn WHERE base <> 0"""


add("s10_comparison_export", compared, _s10())


def exported(s, d):
    from ragbench.operators.annotation import final_notes
    from ragbench.plans.annotation import decisions, notes

    scores_ = f.table(s, d, "documents").select(F.col("doc_id").alias("item"), F.when(F.col("doc_id") % 3 > 0, F.create_map(F.lit("chrf"), F.col("n_chars").cast("double"))).alias("scores"))
    final = final_notes(notes(s, d), decisions(s, d), notes(s, d).select("item").distinct())
    return st.annotation_rows(notes(s, d).withColumn("annotator", F.when(F.col("annotator") == "bia", "=bia").otherwise(F.col("annotator"))), final, scores_, ("chrf",))


def _s11():
    from ragbench.plans.annotation import _N

    return f"""WITH {_N}, v AS (SELECT item, dim, count(DISTINCT score) AS k, count(score) AS n, min(score) AS common, max(score) AS top FROM nt WHERE score IS NOT NULL GROUP BY ALL),
st AS (SELECT item, CASE WHEN max(k) > 1 AND item % 2 > 0 THEN 'pendente' WHEN max(k) > 1 THEN 'adjudicada' WHEN max(n) >= 2 THEN 'concordância' WHEN max(n) = 1 THEN 'uma nota' ELSE 'sem notas' END AS status FROM v GROUP BY item),
fi AS (SELECT item, status, dim, CASE WHEN k > 1 THEN CASE WHEN item % 2 = 0 THEN top END ELSE common END AS final FROM st JOIN v USING (item))
SELECT item, CASE WHEN annotator = 'bia' THEN '''=bia' ELSE annotator END AS annotator, dim, score, final, status, CASE WHEN item % 3 > 0 THEN n_chars::DOUBLE END AS chrf FROM nt LEFT JOIN fi USING (item, dim) JOIN x USING (item)"""


add("s11_annotation_export", exported, _s11())
add("s13_evolved", lambda s, d: st.evolve(f.table(s, d, "customer").select("c_custkey", "c_name"), f.table(s, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"), "s_acctbal")), "SELECT c_custkey, c_name, NULL::DOUBLE AS s_acctbal FROM customer UNION ALL SELECT s_suppkey, NULL, s_acctbal FROM supplier")
add("s14_experiment_page", lambda s, d: st.experiment_page(f.table(s, d, "orders").select(F.col("o_orderkey").alias("experiment"), F.col("o_orderpriority").alias("base"), "o_orderstatus"), "1-URGENT", 3, 20).select("experiment", "o_orderstatus", "total"),
    "SELECT o_orderkey AS experiment, o_orderstatus, (SELECT count(*) FROM orders WHERE o_orderpriority = '1-URGENT') AS total FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY o_orderkey DESC LIMIT 20 OFFSET 40")


def embedded_texts(s, d):
    entities = gr.merge_entities(lines(s, d))
    e, r = st.graph_texts(entities, gr.merge_relations(lines(s, d), entities)[0])
    return e.select(F.lit("entity").alias("kind"), "text").unionByName(r.select(F.lit("relation").alias("kind"), "text"))


add("s17_graph_texts", embedded_texts, f"""WITH {_SRC} SELECT 'entity' AS kind, s_name || ': saldo ' || bal AS text FROM z UNION ALL SELECT DISTINCT 'entity', array_to_string(list_transform(string_split(lower(n_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') || ': ' || r_name FROM z
UNION ALL SELECT 'relation', 'sede ' || lower(s_name) || ' ' || lower(n_name) || ' fica em ' || n_name FROM z UNION ALL SELECT DISTINCT 'relation', 'parte ' || lower(n_name) || ' ' || lower(r_name) || ' faz parte' FROM z""")
add("s17_complete_graphs", lambda s, d: st.complete_only(lines(s, d).select(F.col("chunk_id").alias("graph"), "kind"), replies(s, d).where("chunk_id % 2 = 0").select(F.col("chunk_id").alias("graph"))).groupBy("kind").agg(F.count("*").alias("n")), f"{_LINES} SELECT kind, count(*) AS n FROM ln WHERE chunk_id % 2 = 0 GROUP BY kind")
add("s18_options", lambda s, d: st.options(chunk_table(s, d), graph_rows(s, d), {"chunkers": ["token", "fixed"]}).select("base", F.array_join("indexes", ",").alias("indexes"), F.array_join("extractors", ",").alias("extractors"), F.array_join("chunkers", ",").alias("chunkers")),
    f"WITH {_CT} SELECT base, string_agg(DISTINCT 'whole/' || embedding, ',' ORDER BY 'whole/' || embedding) AS indexes, CASE WHEN bool_or(doc % 3 = 0) THEN 'm' END AS extractors, 'fixed,token' AS chunkers FROM ct GROUP BY base")
add("s15_flat_results", lambda s, d: st.flatten_results(f.table(s, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("experiment_id"), F.when(F.col("o_custkey") % 4 > 0, F.lit("m")).alias("llm")), f.table(s, d, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_partkey").alias("question"), F.when(F.col("l_linenumber") > 2, "ponte").alias("question_type"),
    F.when(F.col("l_linenumber") > 1, F.array(F.struct(F.lit(1).alias("hop"), (F.col("l_quantity") > 25).alias("found")))).alias("hops"), F.array(F.lower("l_returnflag"), F.lit("é")).alias("bridge_entities"), F.when(F.col("l_linenumber") > 3, F.array(F.lit("A"), F.lit("E!"))).alias("graph_names")), f.table(s, d, "customer").select(F.col("c_custkey").alias("experiment_id"), F.col("c_nationkey").cast("long").alias("question"), F.col("c_acctbal").alias("signal"))).groupBy("question_type", "llm").agg(F.count("*").alias("n"), F.count("signal").alias("signals"), F.count_if(F.exists("hops_found", lambda h: h["found"])).alias("hops"), F.sum(F.size(F.filter("bridges_found", lambda b: b["found"]))).alias("bridges")),
    "SELECT CASE WHEN l_linenumber > 2 THEN 'ponte' ELSE 'simples' END AS question_type, CASE WHEN o_custkey % 4 > 0 THEN 'm' ELSE 'gemini' END AS llm, count(*) AS n, count(c_acctbal) AS signals, count(*) FILTER (l_linenumber > 1 AND l_quantity > 25) AS hops, coalesce(sum(1 + (l_returnflag = 'A')::INT) FILTER (l_linenumber > 3), 0)::BIGINT AS bridges FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON c_custkey = o_custkey AND c_nationkey = l_partkey GROUP BY ALL")


def events(s, d):
    return f.table(s, d, "events").select(F.col("user_id").alias("experiment"), "event_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") != "error").alias("ok"))


add("w1_stalls", lambda s, d: jobs.stalls_batch(events(s, d), 3600).select("experiment", "event_id"), "SELECT user_id AS experiment, event_id FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) - ts AS gap FROM events) WHERE gap IS NULL OR gap >= INTERVAL 3600 SECOND")
add("w1_stall_sessions", lambda s, d: jobs.stalls(events(s, d), "3600 seconds").select("experiment", "n").groupBy("experiment").agg(F.count("*").alias("sessions"), F.sum("n").alias("events")),
    "SELECT user_id AS experiment, count(*) FILTER (gap IS NULL OR gap >= INTERVAL 3600 SECOND) AS sessions, count(*)::BIGINT AS events FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) - ts AS gap FROM events) GROUP BY 1")
def alerts(s, d):
    """The stall job over the events' table, drained once: an event after which its experiment was silent for an hour, as far as the stream has moved."""
    place = shared_place(s, "stalls")
    stream = s.readStream.schema(f.table(s, d, "events").schema).parquet(f"{d.rstrip('/')}/events.parque[t]")
    found = jobs.stall_alerts(stream.select(F.col("user_id").alias("experiment"), "event_id", F.col("ts").cast("timestamp").alias("ts")), 3600)
    before = s.conf.get(jobs.ROCKSDB[0])
    s.conf.set(*jobs.ROCKSDB)
    try:
        query = found.writeStream.format("parquet").option("path", f"{place}/alerts").option("checkpointLocation", f"{place}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    finally:
        s.conf.set(jobs.ROCKSDB[0], before)
    query.awaitTermination()
    return s.read.schema(found.schema).parquet(f"{place}/alerts").select("experiment", "event_id")


add("w1_stall_alerts", alerts, """WITH e AS (SELECT user_id, event_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) - ts AS gap FROM events)
SELECT user_id AS experiment, event_id FROM e WHERE (gap IS NULL OR gap >= INTERVAL 3600 SECOND) AND ts <= (SELECT max(ts) FROM events) - INTERVAL 7200 SECOND""")
add("w3_progress_counts", lambda s, d: jobs.progress_counts(events(s, d), "1 day").select("experiment", F.date_format("start", "yyyy-MM-dd").alias("day"), "n", "failed"), "SELECT user_id AS experiment, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY ALL")

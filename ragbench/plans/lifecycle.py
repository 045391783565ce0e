"""Queries on the life of experiments: graph currency, builds, prompts, attempts, exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ragbench.functions.vectors import embed_distinct
from ragbench.operators import annotation as an
from ragbench.operators import chunking, dialogue, graph, graph_build, grid, prep, signals, techniques
from ragbench.operators.retrieval import top_k
from ragbench.plans import frames as f
from ragbench.plans import named
from ragbench.plans.annotation import _PAIR, pair_notes
from ragbench.plans.pipelines import _CTX, _PAGE, contexts, kept_lines
from ragbench.plans.ranking import r6
from ragbench.sources import index_store
from ragbench.sources import tables as st
from ragbench.sources.shared import shared_place, written
from ragbench.streaming import jobs

QUERIES, SQL = {}, {}


def add(name, fn, sql=None):
    QUERIES[name] = fn
    if sql:
        SQL[name] = sql


def pick(values, index):
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def graphs(s, d):
    return f.table(s, d, "orders").select(
        (F.col("o_custkey") % 40).alias("index"), F.concat(F.lit("m"), (F.col("o_orderkey") % 3).cast("string")).alias("extractor"), (F.col("o_custkey") % 7).alias("fingerprint"),
        pick(("v1", "v2"), F.col("o_orderkey") % 2).alias("prompt_version"), F.lit("g1").alias("graph_version"),
    )


def prints(s, d):
    return f.table(s, d, "customer").select((F.col("c_custkey") % 40).alias("index"), (F.col("c_custkey") % 5).alias("fingerprint")).distinct()


_CUR = "cu AS (SELECT DISTINCT o_custkey % 40 AS index, 'm' || (o_orderkey % 3) AS extractor FROM orders WHERE o_orderkey % 2 = 1 AND (o_custkey % 40, o_custkey % 7) IN (SELECT (c_custkey % 40, c_custkey % 5) FROM customer))"
add("g16_current_graphs", lambda s, d: graph.current_graphs(graphs(s, d), prints(s, d), "v2", "g1").distinct(), f"WITH {_CUR} SELECT * FROM cu")
add("g19_to_build", lambda s, d: graph.to_build(graphs(s, d).select("index", F.explode(F.array(F.col("extractor"), F.lit("another"))).alias("extractor")).distinct(), graph.current_graphs(graphs(s, d), prints(s, d), "v2", "g1")), f"WITH {_CUR} SELECT * FROM (SELECT DISTINCT o_custkey % 40 AS index, unnest(['m' || (o_orderkey % 3), 'another']) AS extractor FROM orders) EXCEPT SELECT * FROM cu")
def built(s, d):
    """A graph of the suppliers' replies, built, and then taken as it is: the second time no extraction is asked for."""
    x = f.table(s, d, "supplier").join(f.table(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(f.table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    name = F.concat(F.lit("N"), F.substring(F.md5(F.col("s_suppkey").cast("string")), 1, 12))
    lines = F.array(
        F.concat(F.lit("entidade<|>"), name, F.lit("<|>Organização<|>saldo")), F.concat(F.lit("entidade<|>"), F.col("n_name"), F.lit("<|>Lugar<|>"), F.col("r_name")),
        F.concat(F.lit("relacao<|>"), name, F.lit("<|>"), F.col("n_name"), F.lit("<|>sede<|>fica em")), F.concat(F.lit("relacao<|>"), F.col("n_name"), F.lit("<|>"), F.col("r_name"), F.lit("<|>parte<|>faz parte")),
    )
    known = x.select(F.col("s_suppkey").alias("chunk_id"), F.array_join(lines, "\n").alias("reply"))
    chunks, place = x.select(F.col("s_suppkey").alias("chunk_id"), F.concat(F.lit("# Guia\n\n"), "s_name").alias("text")), shared_place(s, "graphs")

    def refused(missing):
        raise AssertionError("the graph is current")

    graph_build.ensure_graph(chunks, place, "m", lambda missing: missing.select("chunk_id").join(known, "chunk_id"))
    g = graph_build.ensure_graph(chunks, place, "m", refused)
    degree = g["relations"].select(F.explode(F.array("source", "target")).alias("key")).groupBy("key").agg(F.count("*").alias("relations"))
    return g["entities"].join(degree, "key", "left").select("key", "name", "type", F.size("chunk_ids").alias("chunks"), "relations")


add("g19_built", built, """WITH z AS (SELECT 'N' || md5(s_suppkey::VARCHAR)[1:12] AS name, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT lower(name) AS key, name, 'organizacao' AS type, 1 AS chunks, 1 AS relations FROM z
UNION ALL SELECT lower(n_name), n_name, 'lugar', count(*)::INT, count(*) + 1 FROM z GROUP BY n_name
UNION ALL SELECT lower(r_name), r_name, 'outro', count(*)::INT, count(DISTINCT n_name) FROM z GROUP BY r_name""")
add("x2_derived_lists", lambda s, d: grid.derived_lists(f.results(s, d).select(F.col("result_id").alias("no"), "rag", "llm"), ["rag", "llm"]),
    f"WITH {f.RESULT_SQL}, x AS (SELECT 'rag' AS dim, rag AS value, min(result_id) AS at_ FROM r GROUP BY rag UNION ALL SELECT 'llm', llm, min(result_id) FROM r GROUP BY llm) SELECT dim, row_number() OVER (PARTITION BY dim ORDER BY at_, value)::INT AS no, value FROM x")


def attempts(s, d):
    li = f.table(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"))
    return li.select((F.col("l_orderkey") % 9).alias("combo"), F.col("l_orderkey").alias("question"), F.col("l_linenumber").alias("no"), F.when(F.col("q") <= 30, F.concat(F.lit("r"), "l_linenumber")).alias("reply"), F.when(F.col("q") > 30, F.concat(F.lit("e"), "l_linenumber")).alias("error"))


add("x5_outcomes", lambda s, d: grid.outcomes(attempts(s, d)), """WITH a AS (SELECT l_orderkey, l_linenumber AS no, max(l_quantity) AS q FROM lineitem WHERE l_linenumber <= 3 GROUP BY ALL)
SELECT l_orderkey % 9 AS combo, l_orderkey AS question, coalesce('r' || min(no) FILTER (q <= 30), '[ERRO: e' || max(no) FILTER (q > 30) || ']') AS answer FROM a GROUP BY l_orderkey""")
add("x10_active_builds", lambda s, d: grid.active_builds(f.table(s, d, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), pick(("queued", "running", "done", "failed", "done"), F.col("event_id") % 5).alias("status"))).select("id", "status"),
    "SELECT event_id AS id, CASE event_id % 5 WHEN 0 THEN 'queued' ELSE 'running' END AS status FROM events WHERE event_id % 5 < 2")
add("x12_prompt_snapshot", lambda s, d: grid.prompt_snapshot(f.table(s, d, "part").select(pick(("naive", "graph", "hyde", "crag"), F.col("p_partkey") % 4).alias("technique"), F.col("p_partkey").alias("name")), f.results(s, d).select(F.when(F.col("rag") == "oracle", "graph").otherwise("hyde").alias("technique"))).groupBy("technique").agg(F.count("*").alias("prompts")),
    "SELECT ['naive', 'graph', 'hyde'][p_partkey % 4 + 1] AS technique, count(*) AS prompts FROM part WHERE p_partkey % 4 < 3 GROUP BY 1")
add("p8_guide_pairs", lambda s, d: prep.guide_pairs(numbered_lines(s, d)).groupBy("doc").agg(F.count("*").alias("entries"), F.countDistinct("agency").alias("agencies")),
    f"""WITH {_PAGE}, nm AS (SELECT doc, page, line_no, CASE WHEN line_no % 3 = 0 THEN line ELSE line || ' ' || page END AS line FROM kp), nl AS (SELECT *, regexp_matches(line, '\\s\\d{{1,4}}$') AS entry FROM nm),
ag AS (SELECT *, last_value(CASE WHEN NOT entry THEN line END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY page, line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS agency FROM nl)
SELECT doc, count(*) AS entries, count(DISTINCT agency) AS agencies FROM ag WHERE entry AND agency IS NOT NULL GROUP BY doc""")


def numbered_lines(s, d):
    """Lines of the books with the page number at the end of two in three."""
    return kept_lines(s, d).withColumn("line", F.when(F.col("line_no") % 3 == 0, F.col("line")).otherwise(F.concat("line", F.lit(" "), F.col("page").cast("string"))))


def nearest(s, d):
    """The nearest of all short sentences to those, with a letter more, of the stated set of documents."""
    titles = f.short_sentences(s, d)
    wanted = titles.where("doc % 20 = 0").select("name").distinct().select(F.sha1("name").alias("id"), F.concat("name", F.lit("s")).alias("title"))
    return prep.nearest_titles(wanted, titles.select("name").distinct())


add("p8_nearest_titles", nearest)
add("s12_pair_export", lambda s, d: exported_pairs(s, d), f"{_PAIR}, an_ AS (SELECT result_id, max(answer) AS answer FROM r GROUP BY 1) SELECT un.question, annotator, winner, array_to_string(reasons, '|') AS reasons, x.answer AS answer_1, y.answer AS answer_2 FROM un JOIN pr USING (question) LEFT JOIN an_ x ON x.result_id = result_1 LEFT JOIN an_ y ON y.result_id = result_2")


def exported_pairs(s, d):
    r = f.results(s, d)
    sides = an.pair_round(r, "naive/retN/llmO", "oracle/retN/llmO", 5).drop("a_is_1")
    return st.pair_annotation_rows(an.unblind(pair_notes(s, d)).join(sides, "question"), r.groupBy("result_id").agg(F.max("answer").alias("answer")))


add("t3_closed_book", lambda s, d: techniques.prompts(contexts(s, d).where("rank = 1").select("qid", F.col("text").alias("question")), "Pergunta: {question}").select("qid", "key"), f"WITH {_CTX} SELECT qid, sha256('Pergunta: ' || text) AS key FROM ctx WHERE rank = 1")


def hypotheses(s, d):
    """The second message of a conversation stands for the reply that a question's hypothesis prompt gets."""
    rows = contexts(s, d).where("rank = 2").select("qid", "text")
    return rows.join(embed_distinct(rows, "text").hint("merge"), "text").select("qid", "vector")


def message_vectors(s, d):
    c = f.table(s, d, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("chunk_id"), "text")
    return c.join(embed_distinct(c, "text").hint("merge"), "text").select("chunk_id", "vector")


_W = r"list_filter(regexp_split_to_array(lower(text), '\s+'), lambda t: t <> '')"
_H = "(('0x' || substr(md5(w), 1, 7))::BIGINT % 128)"


def _unit(source, key):
    return f"SELECT {key} AS k, {_H} % 64 AS p, sum(CASE WHEN {_H} < 64 THEN 1 ELSE -1 END)::DOUBLE AS v FROM (SELECT {key}, unnest({_W}) AS w FROM {source}) GROUP BY ALL"


add("t5_hyde", lambda s, d: top_k(hypotheses(s, d), message_vectors(s, d), 3).select("qid", "rank", "chunk_id"), f"""WITH {_CTX}, h AS (SELECT qid, text FROM ctx WHERE rank = 2), m AS (SELECT conv_id * 1000 + turn AS id, text FROM conversations WHERE role = 'user'),
a AS ({_unit('h', 'qid')}), b AS ({_unit('m', 'id')}), na AS (SELECT k, sqrt(sum(v * v)) AS n FROM a GROUP BY k), nb AS (SELECT k, sqrt(sum(v * v)) AS n FROM b GROUP BY k),
dt AS (SELECT a.k AS q, b.k AS c, sum(a.v * b.v) AS x FROM a JOIN b USING (p) GROUP BY ALL),
sc AS (SELECT h.qid AS q, m.id AS c, round(coalesce(CASE WHEN na.n * nb.n = 0 THEN 0 ELSE x / (na.n * nb.n) END, 0), 9) AS score FROM h CROSS JOIN m LEFT JOIN dt ON dt.q = h.qid AND dt.c = m.id LEFT JOIN na ON na.k = h.qid LEFT JOIN nb ON nb.k = m.id)
SELECT q AS qid, rank, c AS chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, c)::INT AS rank FROM sc) WHERE rank <= 3""")
add("v5_missing_texts", lambda s, d: missing_texts(s, d), "SELECT sha256(text) AS digest FROM (SELECT DISTINCT text FROM conversations WHERE text IS NOT NULL AND text NOT IN (SELECT text FROM conversations WHERE role = 'user' AND text IS NOT NULL))")


def missing_texts(s, d):
    """Texts whose vectors a table of the user turns' vectors lacks."""
    c = f.table(s, d, "conversations")
    known = c.where("role = 'user'").select("text").distinct().withColumn("vector", F.array(F.lit(0.0)))
    return embed_distinct(c, "text", known).where("vector <> array(0.0D)").select(F.sha2("text", 256).alias("digest"))


def turn_signals(s, d):
    """Signals of the searched text (for every second question the next turn), or of the question where there is none; the corpus is the documents."""
    c = contexts(s, d)
    searched = c.where("rank = 2 and qid % 2 = 0").select("qid", F.nullif(F.btrim("text"), F.lit("")).alias("searched"))
    turns = written(c.where("rank = 1").join(searched, "qid", "left").select("qid", F.col("text").alias("question"), "searched"), "turns")
    docs = f.table(s, d, "documents").where("text is not null")
    asked = turns.where("searched is not null").select("qid", F.col("searched").alias("text"))
    vectors = asked.join(written(embed_distinct(asked, "text"), "vectors"), "text").select("qid", "vector")
    found = top_k(vectors, message_vectors(s, d), 3)
    return r6(dialogue.turn_difficulty(turns, signals.document_frequency(docs), docs.count(), found), "mean_idf", "max_idf", "out_of_corpus", "top_score", "score_gap", "score_spread")


def _d6():
    from ragbench.functions.text import pt_tokens_sql
    from ragbench.plans.analysis import _FLAGS

    return f"""WITH {_CTX}, h AS (SELECT qid, trim(text, ' ') AS text FROM ctx WHERE rank = 2 AND qid % 2 = 0 AND trim(text, ' ') <> ''), m AS (SELECT conv_id * 1000 + turn AS id, text FROM conversations WHERE role = 'user'),
a AS ({_unit('h', 'qid')}), b AS ({_unit('m', 'id')}), na AS (SELECT k, sqrt(sum(v * v)) AS n FROM a GROUP BY k), nb AS (SELECT k, sqrt(sum(v * v)) AS n FROM b GROUP BY k),
dt AS (SELECT a.k AS q, b.k AS c, sum(a.v * b.v) AS x FROM a JOIN b USING (p) GROUP BY ALL),
sc AS (SELECT h.qid AS q, m.id AS c, round(coalesce(CASE WHEN na.n * nb.n = 0 THEN 0 ELSE x / (na.n * nb.n) END, 0), 9) AS score FROM h CROSS JOIN m LEFT JOIN dt ON dt.q = h.qid AND dt.c = m.id LEFT JOIN na ON na.k = h.qid LEFT JOIN nb ON nb.k = m.id),
tk AS (SELECT q AS qid, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, c) AS rank FROM sc),
rs AS (SELECT qid, max(score) AS top_score, max(score) - max(score) FILTER (rank = 2) AS score_gap, stddev_pop(score) AS score_spread FROM tk WHERE rank <= 3 GROUP BY qid),
x AS (SELECT a.qid, coalesce(h.text, a.text) AS text FROM ctx a LEFT JOIN h ON h.qid = a.qid WHERE a.rank = 1),
df AS (SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct({pt_tokens_sql('text')})) AS token FROM documents WHERE text IS NOT NULL) GROUP BY token), nd AS (SELECT count(text) AS n FROM documents),
tn AS (SELECT qid, unnest({pt_tokens_sql('text')}) AS token FROM x), cs AS (SELECT qid, avg(ln((n + 1) / (coalesce(df, 0) + 1))) AS mean_idf, max(ln((n + 1) / (coalesce(df, 0) + 1))) AS max_idf, avg((df IS NULL)::INT) AS out_of_corpus FROM tn LEFT JOIN df USING (token), nd GROUP BY qid)
SELECT qid, len({pt_tokens_sql('text')})::DOUBLE AS question_length, greatest(1, length(text) - length(replace(text, '?', '')))::DOUBLE AS sub_questions, {_FLAGS},
  round(coalesce(mean_idf, 0), 6) AS mean_idf, round(coalesce(max_idf, 0), 6) AS max_idf, round(coalesce(out_of_corpus, 0), 6) AS out_of_corpus, round(top_score, 6) AS top_score, round(score_gap, 6) AS score_gap, round(score_spread, 6) AS score_spread
FROM x LEFT JOIN cs USING (qid) LEFT JOIN rs USING (qid)"""


add("d6_turn_signals", turn_signals, _d6())


def ingested(s, d):
    """The documents' table as a stream, chunked by the ingestion job and drained once; the chunks by base."""
    place = shared_place(s, "ingest")
    # As a pattern, since a stream takes a plain path for a folder.
    stream = s.readStream.schema(f.table(s, d, "documents").schema).parquet(f"{d.rstrip('/')}/documents.parque[t]")
    docs = stream.where("text is not null").select(F.struct("doc_id", "lang").alias("doc"), "text", F.lit("2020-01-01").cast("timestamp").alias("ts"))
    jobs.ingest_stream(docs, f"{place}/chunks", f"{place}/checkpoint", chunking.fixed).awaitTermination()
    return s.read.parquet(f"{place}/chunks").groupBy(F.col("doc.lang").alias("base")).agg(F.count("*").alias("chunks"), F.countDistinct("doc.doc_id").alias("docs"), F.sum(F.length("text")).alias("chars"))


def _w4():
    from ragbench.plans.retrieval import _FIXED

    return f"WITH {_FIXED} SELECT lang AS base, count(*) AS chunks, count(DISTINCT doc) AS docs, sum(length(ch.text))::BIGINT AS chars FROM ch JOIN documents ON doc_id = doc GROUP BY lang"


add("w4_new_documents", ingested, _w4())


def whole_files(s, d):
    """The benchmark's texts written as a file each and scanned back."""
    place = shared_place(s, "files")
    f.table(s, d, "benchmark").where("text is not null").select("item_id", "text").write.partitionBy("item_id").text(place)
    return st.read_documents(s, f"{place}/*").select(F.regexp_extract("path", "item_id=([0-9]+)", 1).cast("long").alias("item_id"), F.sha2("text", 256).alias("digest"))


add("s2_whole_files", whole_files, "SELECT item_id, sha256(text || chr(10)) AS digest FROM benchmark WHERE text IS NOT NULL")
add("w2_streak_alerts", lambda s, d: streak_alerts(s, d), """WITH e AS (SELECT user_id, event_id, event_type <> 'error' AS ok, sum((event_type <> 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS streak, ts FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id, streak ORDER BY ts, event_id) AS k FROM e WHERE NOT ok) SELECT user_id AS experiment, event_id FROM n WHERE k = 2""")


def streak_alerts(s, d):
    """The streaming job over the events' table (a file or a folder of part files), drained once.

    Alerts are written as Parquet beside the stream's checkpoint in the folder that ``spark.checkpoint.dir`` names.
    """
    place = shared_place(s, "streaks")
    # As a pattern, since a stream takes a plain path for a folder.
    stream = s.readStream.schema(f.table(s, d, "events").schema).parquet(f"{d.rstrip('/')}/events.parque[t]")
    timed = stream.select(F.col("user_id").alias("experiment"), "event_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") != "error").alias("ok"))
    alerts = jobs.failure_streaks(timed, 2)
    query = alerts.writeStream.format("parquet").option("path", f"{place}/alerts").option("checkpointLocation", f"{place}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return s.read.schema(alerts.schema).parquet(f"{place}/alerts")


def dumps(s, d):
    """Result dumps of each supplier, one file each in one of three shapes, written and read back."""
    rows = f.table(s, d, "lineitem").groupBy("l_suppkey", F.concat(F.lit("c"), F.col("l_linenumber") % 3).alias("combo"), F.concat(F.lit("q"), "l_partkey").alias("question")).agg(F.min("l_orderkey").alias("id"))
    row = F.struct("id")
    listed = rows.where("l_suppkey % 3 < 2").groupBy("l_suppkey").agg(F.collect_list(row).alias("rows"))
    listed = listed.select("l_suppkey", F.when(F.col("l_suppkey") % 3 == 0, F.to_json("rows")).otherwise(F.to_json(F.struct(F.col("rows").alias("results")))).alias("value"))
    deep = rows.where("l_suppkey % 3 = 2").groupBy("l_suppkey", "combo").agg(F.map_from_entries(F.collect_list(F.struct("question", row))).alias("m"))
    deep = deep.groupBy("l_suppkey").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("combo", "m")))).alias("value"))
    place = shared_place(s, "dumps")
    # One folder and no folder for each file; tasks put their own files in place, as the driver would do so one after another.
    # A given number of tasks, as adaptive execution goes by size and these are small files that each take time.
    tasks = max(int(s.conf.get("spark.sql.shuffle.partitions")), s.sparkContext.defaultParallelism)
    dealt = listed.unionByName(deep).repartition(tasks, F.xxhash64("l_suppkey")).select("value")
    dealt.write.option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(place)
    return st.explode_dump(s, place).select("combo", "question", F.get_json_object("row", "$.id").cast("long").alias("id"))


add("s16_dump_rows", dumps, """SELECT CASE WHEN l_suppkey % 3 = 2 THEN 'c' || (l_linenumber % 3) END AS combo, CASE WHEN l_suppkey % 3 = 2 THEN 'q' || l_partkey END AS question, min(l_orderkey) AS id
FROM lineitem GROUP BY l_suppkey, l_linenumber % 3, l_partkey""")


def by_name(s, d):
    """Every document through the chunkers that a configuration names."""
    named_ = [n for n in ("fixed", "token")]
    made = [named.get("chunkers", n)(f.docs(s, d)).select(F.lit(n).alias("chunker"), F.length("text").alias("size")) for n in named_]
    return made[0].unionByName(made[1]).groupBy("chunker").agg(F.count("*").alias("chunks"), F.sum("size").alias("characters"))


def _c7():
    from ragbench.functions.text import words_sql
    from ragbench.plans.retrieval import _FIXED

    return f"""WITH {_FIXED}, t AS (SELECT doc_id AS doc, {words_sql('text')} AS t FROM documents WHERE text IS NOT NULL), x2 AS (SELECT doc, t, unnest(range(0, greatest(len(t) - 20, 1), 236)) AS pos FROM t WHERE len(t) > 0)
SELECT 'fixed' AS chunker, count(*) AS chunks, sum(length(text))::BIGINT AS characters FROM ch UNION ALL SELECT 'token', count(*), sum(length(array_to_string(t[pos + 1:pos + 256], ' ')))::BIGINT FROM x2"""


add("c7_named_chunkers", by_name, _c7())


def indexed(s, d):
    """Documents appended to a store in two commits, one base deleted between them: ids by index, as they stand."""
    rows = f.table(s, d, "documents").select(F.col("source").alias("base"), F.lit("whole").alias("chunking"), F.col("lang").alias("embedding"), F.col("doc_id").alias("doc"), F.lit(0).alias("chunk_index"))
    place, base = shared_place(s, "store"), "src1"
    index_store.append(rows.where("doc % 3 > 0"), place)
    index_store.delete_base(s, place, base)
    index_store.append(rows.where("doc % 3 = 0"), place)
    return index_store.chunks(s, place).select("base", "embedding", "doc", "chunk_id")


add("s3_s7_index_store", indexed, """WITH a AS (SELECT source, lang, doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) - 1 AS id FROM documents WHERE doc_id % 3 > 0),
h AS (SELECT source, lang, count(*) AS n FROM a WHERE source IS DISTINCT FROM 'src1' GROUP BY ALL),
b AS (SELECT d.source, d.lang, doc_id, row_number() OVER (PARTITION BY d.source, d.lang ORDER BY doc_id) - 1 + coalesce(max(n) OVER (PARTITION BY d.source, d.lang), 0) AS id FROM documents d LEFT JOIN h ON h.source IS NOT DISTINCT FROM d.source AND h.lang IS NOT DISTINCT FROM d.lang WHERE doc_id % 3 = 0)
SELECT source AS base, lang AS embedding, doc_id AS doc, id AS chunk_id FROM a WHERE source IS DISTINCT FROM 'src1' UNION ALL SELECT source, lang, doc_id, id FROM b""")

"""Distributed fits and ranks, string joins, stall alerts, sketches, exact means."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from ragbench.functions.similarity import indel
from ragbench.operators import annotation, comparison, graph, prep, ranking, retrieval, signals, strings
from ragbench.plans import frames
from ragbench.streaming import jobs

SF = "/root/testdata/sf0.001"


def test_rasch_of_all_scopes_equals_the_plain_fit(spark):
    rng = random.Random(4)
    rows = [(s, f"p{p}", q, min(1.0, max(0.0, rng.gauss(0.5 + 0.02 * p - 0.01 * q, 0.3)))) for s in ("a", "b") for p in range(9) for q in range(70 if s == "a" else 12) if rng.random() < 0.8]
    rows += [("short", "p1", q, 1.0) for q in range(2)] + [("extreme", f"p{p}", q, float(q > 1)) for p in range(3) for q in range(4)]
    got = {(r["scope"], r["question"]): (r["difficulty"], r["reliable"]) for r in signals.rasch(spark.createDataFrame(rows, "scope string, person string, question int, y double")).collect()}
    assert {s for s, _ in got} == {"a", "b", "extreme"}
    for scope in ("a", "b", "extreme"):
        mine = [r for r in rows if r[0] == scope]
        people, questions = sorted({r[1] for r in mine}), sorted({r[2] for r in mine})
        _, b = signals.fit_cells(np.array([people.index(r[1]) for r in mine]), np.array([questions.index(r[2]) for r in mine]), np.array([r[3] for r in mine]))
        for q, want in zip(questions, b, strict=True):
            assert abs(got[scope, q][0] - want) < 1e-6 and got[scope, q][1] == (len(questions) >= 50)
    assert signals.rasch(spark.createDataFrame([], "scope string, person string, question int, y double")).count() == 0


def test_spearman_equals_ranks_by_hand(spark):
    rng = random.Random(9)
    rows = [(s, rng.randrange(12), rng.choice([None, rng.randrange(6)])) for s in ("x", None) for _ in range(300)] + [("flat", 1, k) for k in range(5)] + [("two", 1, 2), ("two", 2, 3)]

    def plain(pairs):
        rank = lambda v: [sum(x < y for x in v) + (sum(x == y for x in v) + 1) / 2 for y in v]
        return float(np.corrcoef(rank([p[0] for p in pairs]), rank([p[1] for p in pairs]))[0, 1])

    got = {r["s"]: (r["n"], r["rho"]) for r in signals.spearman(spark.createDataFrame(rows, "s string, a int, b int"), ["s"], "a", "b").collect()}
    for s in ("x", None):
        pairs = [(a, b) for t, a, b in rows if t == s and b is not None]
        assert got[s][0] == len(pairs) and abs(got[s][1] - plain(pairs)) < 1e-9
    assert got["flat"] == (5, None) and got["two"] == (2, None)


def all_similar(names, least):
    """Every pair, those with too few common letters left out at once: the common subsequence is no longer than they are many."""
    letters = sorted(set("".join(names)))
    counts = np.array([[n.count(c) for c in letters] for n in names], dtype=np.int16)
    size, found = np.array([len(n) for n in names]), set()
    for i in range(len(names)):
        common = np.minimum(counts[i], counts[i + 1 :]).sum(1)
        for j in np.flatnonzero(200 * common >= least * (size[i] + size[i + 1 :])) + i + 1:
            if indel(names[i], names[j]) >= least:
                found.add((i, int(j)))
    return found


def test_string_join_finds_every_similar_pair(spark):
    cut = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(F.explode(F.split("text", r"[.\n]")).alias("n")).select(F.lower(F.btrim("n")).alias("n")).where("length(n) BETWEEN 8 AND 40")
    names = [r[0] for r in cut.distinct().orderBy("n").limit(4600).collect()]
    rng = random.Random(2)
    for n in rng.sample(names, 360):  # with neighbours at the bound
        x = list(n)
        for _ in range(rng.randrange(1, 1 + max(1, int(0.15 * len(x))))):
            if rng.random() < 0.5:
                del x[rng.randrange(len(x))]
            else:
                x.insert(rng.randrange(len(x) + 1), rng.choice("abcdé "))
        names.append("".join(x))
    names = sorted({*names, "x" * 60, "x" * 55 + "y", "a", "ab", "a"})
    table = spark.createDataFrame(list(enumerate(names)), "id int, text string").repartition(8)
    want = all_similar(names, 85.0)
    assert {(r[0], r[1]) for r in strings.similar_strings(table).select("left_id", "right_id").collect()} == want and len(want) > 200
    few = strings.candidates(table, None, 85.0).count()
    assert few < 40 * len(names)  # of some 2,500 pairs a name


def test_signatures_are_met_by_strings_at_the_bound():
    rng = random.Random(3)
    met = 0
    for _ in range(6000):
        a = "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 34)))
        b = list(a)
        for _ in range(rng.randrange(0, 9)):
            if rng.random() < 0.5 and b:
                del b[rng.randrange(len(b))]
            else:
                b.insert(rng.randrange(len(b) + 1), rng.choice("abcd"))
        b = "".join(b)
        for least in (85.0, 70.0):
            if b and indel(a, b) >= least and (least > 80 or len(a + b) < 30):
                met += 1
                s, r = sorted((a, b), key=len)
                assert np.intersect1d(strings.signatures(s, least, False), strings.signatures(r, least, True)).size
    assert met > 3000


def test_nearest_titles_need_no_common_word(spark):
    wanted = spark.createDataFrame([(1, "Alvaráde obras"), (2, "nada parecido"), (3, None), (4, "Taxa")], "id int, title string")
    titles = spark.createDataFrame([("Alvará de Obras",), ("Alvara de obras",), ("Taxa",), (None,), ("",)], "name string")
    got = {r["id"]: (r["nearest"], round(r["ratio"], 4)) for r in prep.nearest_titles(wanted, titles).collect()}
    assert got == {1: ("Alvara de obras", round(2 * 14 / 29, 4)), 4: ("Taxa", 1.0)}


def test_names_of_one_spelling_are_synonyms(spark):
    rows = [("avó", "Avó"), ("avo", "Avo"), ("x", "Outro nome")]
    got = {tuple(r) for r in graph.synonyms(spark.createDataFrame(rows, "key string, name string")).collect()}
    assert got == {("avó", "avo", 1.0), ("avo", "avó", 1.0)}


def test_stall_alerts_of_a_stream_with_late_events(spark, tmp_path):
    rng = random.Random(1)
    events = [(rng.choice([1, 2, 3]), i, 1_700_000_000 + rng.randrange(0, 40_000) + rng.random()) for i in range(60)]
    events += [(1, 500, events[0][2])]  # two at one moment
    order = sorted(events, key=lambda e: e[2] + rng.uniform(0, 400))
    for k in range(5):
        part = order[k * 13 : (k + 1) * 13] + ([(99, 1000, 1_700_200_000.0)] if k == 4 else [])
        frame = spark.createDataFrame(part, "experiment long, event_id long, s double").withColumn("ts", F.timestamp_micros((F.col("s") * 1e6).cast("long"))).drop("s")
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # files are taken by their times
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    before = spark.conf.get(jobs.ROCKSDB[0])
    spark.conf.set(*jobs.ROCKSDB)
    try:
        query = jobs.stall_alerts(stream, 600, "10 minutes").writeStream.format("memory").queryName("silent").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    finally:
        spark.conf.set(jobs.ROCKSDB[0], before)
    query.awaitTermination(200)
    batch = jobs.stalls_batch(spark.read.parquet(str(tmp_path / "in")), 600)
    got = sorted((r["experiment"], r["event_id"]) for r in spark.table("silent").collect())
    assert got == sorted((r["experiment"], r["event_id"]) for r in batch.collect() if r["experiment"] != 99) and len(got) > 20


def test_coded_vectors_find_the_true_neighbours(spark):
    d = "/root/testdata/sf0.1"
    q, c = frames.vector_questions(spark, d), frames.vector_chunks(spark, d)
    pairs = lambda df: {(r["qid"], r["chunk_id"]) for r in df.collect()}
    index = retrieval.vector_index(c)
    exact, near = pairs(retrieval.top_k(q, c, 10)), pairs(retrieval.approximate_top_k(q, c, 10, index=index))
    assert len(exact & near) / len(exact) > 0.95
    n, size = index[0].agg(F.count("*"), F.avg(F.length("code"))).first()
    assert n == c.count() and (size + 100 * 256 / n) / 256 < 0.15  # codes, and the vectors ranked for a question


def test_quantiles_of_merged_sketches(spark):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.normal(size=20_000), rng.exponential(size=20_000)])
    rows = spark.createDataFrame([("g", int(i % 7), float(v)) for i, v in enumerate(values)] + [("none", 0, None), ("one", 0, 5.0)], "g string, day int, v double")
    parts = ranking.quantile_sketches(rows, ["g", "day"], "v")
    got = {r["g"]: r for r in ranking.sketched_quantiles(parts, ["g"], {"q1": 0.25, "median": 0.5, "q3": 0.75, "p95": 0.95}).collect()}
    assert got["g"]["n"] == len(values) and got["one"]["median"] == 5.0
    for name, q in (("q1", 0.25), ("median", 0.5), ("q3", 0.75), ("p95", 0.95)):
        assert abs((values <= got["g"][name]).mean() - q) < 0.02
    exact = ranking.quartiles(rows.where("g = 'g'"), "g", "v").first()
    assert exact["q1"] < exact["median"] < exact["q3"]


def test_sign_test_equals_the_binomial_sum():
    from math import comb

    for n in (1, 2, 3, 10, 33, 501):
        for k in range(0, n + 1, max(1, n // 20)):
            assert abs(annotation.fair_tail(n, k) - sum(comb(n, i) for i in range(k + 1)) / 2**n) < 1e-11


@pytest.mark.parametrize("level", ["nominal", "interval", "ordinal"])
def test_alpha_equals_the_sum_over_pairs(spark, level):
    rng = random.Random(7)
    notes = [(i, a, "d", rng.choice([None, 1, 2, 2, 3, 5])) for i in range(40) for a in range(rng.randrange(1, 6))]
    units = {}
    for i, _, _, s in notes:
        if s is not None:
            units.setdefault(i, []).append(s)
    units = [u for u in units.values() if len(u) > 1]
    flat = sorted(x for u in units for x in u)
    freq = {v: flat.count(v) for v in set(flat)}

    def delta(a, b):
        if level == "nominal":
            return float(a != b)
        if level == "interval":
            return (a - b) ** 2
        low, high = min(a, b), max(a, b)
        return (sum(n for v, n in freq.items() if low <= v <= high) - (freq[a] + freq[b]) / 2) ** 2

    seen = sum(delta(a, b) / (len(u) - 1) for u in units for i, a in enumerate(u) for j, b in enumerate(u) if i != j)
    chance = sum(delta(a, b) for i, a in enumerate(flat) for j, b in enumerate(flat) if i != j) / (len(flat) - 1)
    got = annotation.krippendorff(spark.createDataFrame(notes, "item int, annotator int, dim string, score int"), ["dim"], level).first()["alpha"]
    assert abs(got - (1 - seen / chance)) < 1e-9


def test_an_unknown_experiment_is_an_error(spark):
    items = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b")], "experiment int, combo string")
    runs, known = spark.createDataFrame([(1, "a"), (2, "b")], "experiment int, combo string"), spark.createDataFrame([(1,), (2,)], "experiment int")
    assert {tuple(r) for r in comparison.requested(items, runs, known).collect()} == {(1, "a", None), (1, "b", "unknown run")}
    with pytest.raises(comparison.UnknownExperiment):
        comparison.requested(items.union(spark.createDataFrame([(7, "a")], items.schema)), runs, known)


def test_exported_means_do_not_hang_on_the_order_of_rows(spark):
    from ragbench.plans.pipelines import QUERIES

    before, seen = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in ("1", "5", "13"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            seen.append(sorted(str(tuple(r)) for r in QUERIES["s10_comparison_export"](spark, "/root/testdata/sf0.01").collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1] == seen[2]


def test_index_store_by_commits(spark, tmp_path, monkeypatch):
    from ragbench.sources import index_store

    place = str(tmp_path / "store")
    rows = lambda docs, base="a": spark.createDataFrame([(base, "fixed", None if base == "b" else "e", d, k) for d in docs for k in range(2)], "base string, chunking string, embedding string, doc int, chunk_index int")
    ids = lambda: sorted((r["base"], r["doc"], r["chunk_index"], r["chunk_id"]) for r in index_store.chunks(spark, place).collect())
    index_store.append(rows([1, 2]), place)
    with monkeypatch.context() as m:
        m.setattr(index_store, "_record", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            index_store.append(rows([7, 8]), place)
    index_store.append(rows([3]).union(rows([1], "b")), place)
    assert ids() == [("a", 1, 0, 0), ("a", 1, 1, 1), ("a", 2, 0, 2), ("a", 2, 1, 3), ("a", 3, 0, 4), ("a", 3, 1, 5), ("b", 1, 0, 0), ("b", 1, 1, 1)]
    index_store.delete_base(spark, place, "a")
    assert {r[0] for r in ids()} == {"b"}
    index_store.append(rows([9]), place)
    want = [("a", 9, 0, 0), ("a", 9, 1, 1), ("b", 1, 0, 0), ("b", 1, 1, 1)]
    assert ids() == want and index_store.vacuum(spark, place) == 3 and ids() == want


def test_subword_windows(spark):
    import base64

    import tiktoken

    from ragbench.operators import chunking

    path = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    plain = tiktoken.Encoding("plain", pat_str=chunking.RANKS_PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("doc"), "text").unionByName(spark.createDataFrame([(9001, None), (9002, ""), (9003, "\U0001f600" * 300), (9004, "ab " * 90)], "doc long, text string"))
    texts = {r[0]: r[1] for r in docs.collect()}
    got = {}
    for r in chunking.subword_tokens(docs, path).collect():
        got.setdefault(r["doc"], []).append((r["chunk_index"], r["text"]))
    for doc, text in texts.items():
        ids = plain.encode_ordinary(text or "")
        windows = chunking.token_windows(ids, 256, 20)
        assert all(len(w) <= 256 for w in windows) and [x for k, w in enumerate(windows) for x in w[20 * (k > 0) :]] == ids
        pieces = [t for w in windows if (t := plain.decode(w, errors="replace")).strip()]
        assert [t for _, t in sorted(got.get(doc, []))] == pieces
        assert plain.decode(ids) == (text or "")


def test_a_broken_build_leaves_no_graph_and_the_next_goes_on(spark, tmp_path):
    from ragbench.operators import graph_build

    chunks = spark.createDataFrame([(1, "# T\n\numa"), (2, "duas"), (3, "duas"), (4, "# só título"), (5, "cinco")], "chunk_id int, text string")
    asked = []

    def extract(missing, fails=(), breaks=False):
        rows = missing.collect()
        asked.append(sorted(r["chunk_id"] for r in rows))
        if breaks:
            raise OSError("no model")
        return spark.createDataFrame([(r["chunk_id"], None if r["chunk_id"] in fails else f"entidade<|>E{r['chunk_id']} nome<|>Lugar<|>d\nrelacao<|>E{r['chunk_id']} nome<|>Centro<|>em<|>fica") for r in rows], "chunk_id int, reply string")

    place = str(tmp_path / "g")
    with pytest.raises(OSError):
        graph_build.ensure_graph(chunks, place, "m", lambda x: extract(x, breaks=True))
    assert graph_build.current_graph(spark, graph_build.graph_place(chunks, place, "m", "1", "1")) is None
    g = graph_build.ensure_graph(chunks, place, "m", lambda x: extract(x, fails=(5,)))
    assert g["meta"].first()["failed_chunks"] == 1 and {r["key"] for r in g["entities"].collect()} == {"e1 nome", "e2 nome", "centro"}
    assert graph_build.ensure_graph(chunks, place, "m", extract)["meta"].first()["run"] == g["meta"].first()["run"]
    more = chunks.union(spark.createDataFrame([(6, "seis")], chunks.schema))
    h = graph_build.ensure_graph(more, place, "m", extract)
    assert asked == [[1, 2, 5], [1, 2, 5], [5, 6]] and {r["key"] for r in h["entities"].collect()} == {"e1 nome", "e2 nome", "e5 nome", "e6 nome", "centro"}
    with pytest.raises(graph_build.EveryChunkFailed):
        graph_build.ensure_graph(chunks.where("chunk_id = 1"), place, "other", lambda x: extract(x, fails=(1,)))
    assert graph_build.current_graph(spark, graph_build.graph_place(chunks.where("chunk_id = 1"), place, "other", "1", "1")) is None


def test_string_join_by_blocks_shuffles_no_signatures(spark, monkeypatch):
    """Two tables, in small blocks, and cells where looking at all characters is less work than signatures."""
    monkeypatch.setattr(strings, "_signed", None)
    monkeypatch.setattr(strings, "BLOCK", 12)
    rng = random.Random(8)
    names = ["".join(rng.choice("ab ") for _ in range(rng.randrange(6, 24))) for _ in range(60)]
    names = sorted({*names, *(n[1:] + "c" for n in names)})
    one, two = (spark.createDataFrame([(k, n) for k, n in enumerate(names) if k % 3 < 2 or side], "id int, text string") for side in (0, 1))
    want = {(k, j) for k, a in enumerate(names) for j, b in enumerate(names) if indel(a, b) >= 85}
    assert {(r[0], r[1]) for r in strings.similar_strings(one, two).collect()} == {p for p in want if p[0] % 3 < 2}
    assert {(r[0], r[1]) for r in strings.similar_strings(two).collect()} == {p for p in want if p[0] < p[1]} and len(want) > len(names)


def test_packing_runs_through_a_long_document(spark):
    rng = random.Random(5)
    rows = [(d, k, "x" * rng.choice([0, 3, 40, 200, 900])) for d in ("a", "b") for k in range(400)] + [("only", 0, ""), ("long", 0, "y" * 2000)]
    want = set()
    for d in ("a", "b", "long"):
        blocks, cur = [], ""
        for _, _, x in sorted(r for r in rows if r[0] == d):
            longer = f"{cur}\n{x}" if cur else x
            if not cur or len(longer) <= 800:
                cur = longer
            else:
                blocks, cur = [*blocks, cur], x
        want |= {(d, k, t) for k, t in enumerate([*blocks, cur]) if t}
    assert {tuple(r) for r in prep.pack(spark.createDataFrame(rows, "doc string, para long, text string").repartition(3)).collect()} == want
    many = spark.range(200_000).select(F.lit("book").alias("doc"), F.col("id").alias("para"), F.lit("w" * 99).alias("text"))
    start = time.time()
    assert prep.pack(many).count() == 25_000 and time.time() - start < 60


def test_a_page_number_of_five_digits_is_none(spark):
    """The contents list's SQL reads page numbers as the operator does: up to four digits."""
    import duckdb

    from ragbench.plans import lifecycle

    lines = [("b", p, n, f"line {'x' * n}") for p in (9, 12345) for n in range(7)]
    numbered = [(d, p, n, t if n % 3 == 0 else f"{t} {p}") for d, p, n, t in lines]
    got = [tuple(r) for r in prep.guide_pairs(spark.createDataFrame(numbered, "doc string, page int, line_no int, line string")).groupBy("doc").agg(F.count("*"), F.countDistinct("agency")).collect()]
    sql = "WITH nm AS (SELECT doc, page" + lifecycle.SQL["p8_guide_pairs"].split("nm AS (SELECT doc, page", 1)[1]
    con = duckdb.connect()
    con.execute("CREATE TABLE kp (doc VARCHAR, page INT, line_no INT, line VARCHAR)")
    con.executemany("INSERT INTO kp VALUES (?, ?, ?, ?)", lines)
    assert con.execute(sql).fetchall() == got == [("b", 4, 2)]


def test_evidence_distance_by_blocks_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(signals, "QUESTIONS", 3)
    monkeypatch.setattr(signals, "PASSAGES", 7)
    rng = random.Random(6)
    rows = [(k, k % 3, [rng.gauss(0, 1) for _ in range(4)] if k % 11 else [0.0] * 4) for k in range(90)] + [(90, None, [1.0] * 4), (91, 1, None), (92, 7, [1.0] * 4)]
    table = spark.createDataFrame(rows, "id long, label int, vector array<double>")
    asked = table.where("id % 5 = 0 or id > 89").withColumnRenamed("id", "qid")
    pairs = asked.withColumnRenamed("vector", "question_vector").join(table.select("label", F.col("vector").alias("passage_vector")), "label")
    want = {r[0]: r[1] for r in signals.evidence_distance(pairs.where("question_vector is not null and passage_vector is not null")).collect()}
    got = signals.evidence_distance_within(asked, table)
    assert "CoGroup" in got._jdf.queryExecution().toString()  # no row for each pair
    found = {r[0]: r[1] for r in got.collect()}
    assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-9 for k in want)


def test_latency_quantiles_need_no_task_with_a_whole_level(spark):
    rng = random.Random(7)
    rows = [(m, rng.choice([None, float(rng.randrange(40))]), 2) for m in ("a", "b") for _ in range(301)] + [(None, 5.0, 1), ("none", None, 3)]
    log = spark.createDataFrame(rows, "llm string, ms double, tokens int").repartition(5)
    got = ranking.latency_summary(log, "llm", "ms", "tokens")
    plan = got._jdf.queryExecution().toString().lower()
    assert "percentile" not in plan
    plain = log.groupBy("llm").agg(F.count("*"), F.expr("percentile_disc(0.5) within group (order by ms)"), F.expr("percentile_disc(0.95) within group (order by ms)"), F.sum("ms") / 1000, F.sum("tokens"))
    assert {tuple(r)[:6] for r in got.collect()} == {tuple(r) for r in plain.collect()}

"""Queries at the sizes and in the odd cases that findings named."""

import random
from types import SimpleNamespace

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from ragbench.functions.similarity import lcs_length
from ragbench.operators import chunking, comparison, graph, ranking, retrieval, signals, strings
from ragbench.plans import analysis, frames, lifecycle, registry
from ragbench.sources import tables
from ragbench.streaming import jobs

SF = "/root/testdata/sf0.001"


def test_semantic_cuts_do_not_hang_on_rounding(spark):
    """Both largest of nine distances are 1 + 1 / sqrt(6), though their last bits differ, so neither exceeds the percentile between them."""
    text = (
        "In it er. With ththstble. Of esnd of. That lyreer thontier the is handly, erly threshea erennt haed ththenor thon to.\n"
        "Of ndth, th thinnt a, thernd enly st er and anhe for eastor oror as eren the and thtithhe, it. Erheth of anshen esin thwh, in. Is. Hently the, stanin of, thre.\n"
        "Thingsh thre stor the thndbleer from tied erhean thorntnt totionwhnd ndin eratrean thinged the ating thou thatbletion st erinou erntea. The tiingth sherble erwh."
    )
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.execute("INSERT INTO documents VALUES (1, ?)", [text])
    got = chunking.semantic(spark.createDataFrame([(1, text)], "doc long, text string"))
    assert [tuple(r) for r in got.select("doc", "chunk_index").collect()] == [(1, 0)]
    assert [r[:2] for r in con.execute(registry.sql()["c5_semantic_chunks"]).fetchall()] == [(1, 0)]


def test_a_rasch_step_shuffles_no_cells(spark, monkeypatch):
    """A question's cells are packed once, and no later table has a row for each of them."""
    sizes, plain = {}, signals.written

    def counted(rows, name):
        out = plain(rows, name)
        sizes.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(signals, "written", counted)
    rows = [("all", f"p{p}", q, (p * q) % 7 / 6) for p in range(8) for q in range(40)] + [("all", None, 3, 0.5), (None, "p1", 3, 0.5)]
    got = signals.rasch(spark.createDataFrame(rows, "scope string, person string, question int, y double").repartition(3))
    assert got.count() == 40
    assert max(n for found in sizes.values() for n in found) == 40


def test_rasch_cells_shuffle_rows_before_scopes_multiply_them(spark):
    plan = analysis.QUERIES["i20_rasch_cells"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert shuffles and not any("scope" in line for line in shuffles)


class _Store:
    """A key's state and timers as a stateful processor sees them, with the number of calls."""

    def __init__(self):
        self.calls, self.timers = 0, set()

    def getValueState(self, name, schema):
        store, held = self, []

        class State:
            def exists(self):
                store.calls += 1
                return bool(held)

            def get(self):
                store.calls += 1
                return held[0]

            def update(self, value):
                store.calls += 1
                held[:] = [value]

            def clear(self):
                store.calls += 1
                held.clear()

        return State()

    def registerTimer(self, ms):
        self.calls += 1
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.calls += 1
        self.timers.discard(ms)


def test_stall_state_calls_do_not_grow_with_events():
    """Late and repeated events in batches: alerts are those of the whole table, for a few calls a batch."""
    rng = random.Random(3)
    us = [int(x * 1e6) + rng.randrange(3) for x in (rng.randrange(40_000) for _ in range(2_000))]
    events = sorted((at, k) for k, at in enumerate(us))
    want = {e for (at, e), (after, _) in zip(events, events[1:]) if after - at >= 60_000_000} | {events[-1][1]}
    seen = sorted(events + events[::50], key=lambda e: e[0] + rng.randrange(200_000_000))
    store, job, got = _Store(), jobs._Silence(60_000), []
    job.init(store)
    for k in range(0, len(seen), 500):
        batch = pd.DataFrame(seen[k : k + 500], columns=["us", "event_id"])
        assert not list(job.handleInputRows((1,), iter([batch[:200], batch[200:]]), None))
        mark = min((e[0] for e in seen[k + 500 :]), default=10**12) // 1000
        while due := [t for t in sorted(store.timers) if t <= mark][:1]:
            store.timers.discard(due[0])
            now = SimpleNamespace(getCurrentWatermarkInMs=lambda: mark)
            got += [e for f in job.handleExpiredTimer((1,), now, SimpleNamespace(getExpiryTimeInMs=lambda: due[0])) for e in f["event_id"]]
    assert sorted(got) == sorted(want) and len(want) > 20 and store.calls < 100


def test_wide_results_and_their_mean_are_one_grouping(spark):
    rows = [("a", 1, "m", 0.5), ("a", 1, "n", 1.0), (None, 2, "n", 0.25), ("b", 1, "m", None)]
    wide = tables.results_wide(spark.createDataFrame(rows, "combo string, question int, metric string, value double"), ["combo", "question"])
    assert "Join" not in wide._jdf.queryExecution().optimizedPlan().toString()
    assert wide.columns == ["combo", "question", "m", "n", "media"]
    assert {tuple(r) for r in wide.collect()} == {("a", 1, 0.5, 1.0, 0.75), (None, 2, None, 0.25, 0.25), ("b", 1, None, None, None)}


def test_expansion_groups_nothing_but_its_scores(spark):
    seeds = spark.createDataFrame([(1, 10, 1.0), (1, 11, 0.5)], "qid int, key int, score double")
    relations = spark.createDataFrame([(10, 12), (12, 10), (11, 12), (11, 11)], "source int, target int")
    links = spark.createDataFrame([(11, 13, 0.9)], "key int, other int, weight double")
    spec = spark.createDataFrame([(k, 1.0) for k in (10, 11, 12, 13)], "key int, specificity double")
    got = graph.expand(seeds, relations, links, spec)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
    assert {tuple(r) for r in got.collect()} == {(1, 10, 1.0), (1, 11, 0.5), (1, 12, 0.5), (1, 13, 0.45)}


def test_a_bucket_of_experiments_costs_the_state_calls_of_one_key(spark):
    """F8: the runs of all experiments of a key are one value; ids beyond 2**53 and events without an experiment stay apart."""
    rng = random.Random(4)
    events = [(2**53 + rng.randrange(300), k, 1_000_000_000 * rng.randrange(2_000)) for k in range(6_000)]
    rows = spark.createDataFrame(events, "experiment long, event_id long, us long").withColumn("ts", F.timestamp_micros("us"))
    want = {(r["experiment"], r["event_id"]) for r in jobs.stalls_batch(rows, 3_600).collect()}
    store, job, got = _Store(), jobs._Silence(3_600_000), set()
    job.init(store)
    for k in range(0, len(events), 1_500):
        job.handleInputRows((7,), iter([pd.DataFrame(events[k : k + 1_500], columns=["experiment", "event_id", "us"])]), None)
    for frame in job.handleExpiredTimer((7,), SimpleNamespace(getCurrentWatermarkInMs=lambda: 10**12), None):
        got |= set(zip(frame["experiment"], frame["event_id"]))
    assert got == want and len(want) > 1_000 and store.calls < 60
    nobody = jobs._Silence(3_600_000)
    nobody.init(_Store())
    nobody.handleInputRows((None,), iter([pd.DataFrame({"experiment": [None, None], "us": [0, 5_000_000_000], "event_id": [1, 2]})]), None)
    found = pd.concat(nobody.handleExpiredTimer((None,), SimpleNamespace(getCurrentWatermarkInMs=lambda: 10**12), None))
    assert found["event_id"].tolist() == [1, 2] and found["experiment"].isna().all()


def test_dumps_are_files_of_one_folder_and_read_once(spark, tmp_path, monkeypatch):
    """a file for each supplier, no folder for each, one scan for all three shapes."""
    monkeypatch.setattr(lifecycle, "shared_place", lambda s, name: f"{tmp_path}/{name}")
    rows = registry.queries()["s16_dump_rows"](spark, SF)
    suppliers = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_suppkey").distinct().count()
    assert len(list((tmp_path / "dumps").glob("part-*"))) == suppliers
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1


def test_dumps_of_odd_shapes(spark, tmp_path):
    for name, text in {"a": '[{"id": 1}, null]', "b": '{"results": []}', "c": '{"c": {"q": {"id": 2}}, "d": null, "e": {}}', "d": "{}", "e": "3"}.items():
        (tmp_path / f"{name}.json").write_text(text)
    got = {tuple(r) for r in tables.explode_dump(spark, f"{tmp_path}/*.json").collect()}
    assert got == {(None, None, '{"id":1}'), (None, None, None), ("c", "q", '{"id":2}')}


def test_coded_search_holds_tables_of_a_few_questions(spark, monkeypatch):
    """what a worker gets grows with a block's questions by their vectors, not by their scores with all centres."""
    sent, plain = [], spark.sparkContext.broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: (sent.append(value), plain(value))[1])
    q, c = frames.vector_questions(spark, SF), frames.vector_chunks(spark, SF)
    got = retrieval.approximate_top_k(q, c, 10)
    arrays = [x for value in sent if isinstance(value, tuple) for x in value if hasattr(x, "nbytes")]
    width, books = len(q.first()["vector"]), arrays[-1]
    assert len(arrays) == 2 and arrays[0].size == q.count() * width and books.size <= 256 * width
    near = {(r["qid"], r["chunk_id"]) for r in retrieval.top_k(q, c, 10).collect()}
    assert len(near & {(r["qid"], r["chunk_id"]) for r in got.collect()}) >= 0.95 * len(near)


def test_subword_windows_come_in_frames_of_many_documents(spark, monkeypatch):
    """a frame for each document took longer than its tokens."""
    made, plain, job = [], chunking._frame, []
    monkeypatch.setattr(chunking, "_frame", lambda rows, names: (made.append(len(rows)), plain(rows, names))[1])
    docs = spark.createDataFrame([(0, "a")], "doc long, text string")
    monkeypatch.setattr(type(docs), "mapInPandas", lambda self, run, schema: job.append(run))
    chunking.subword_tokens(docs, "/opt/tokenizers/byte_bpe_50k.tiktoken", 5, 1)
    texts = pd.DataFrame({"doc": range(300), "text": ["one two three four five six seven"] * 300})
    frames_ = list(job[0](iter([texts[:200], texts[200:]])))
    assert len(made) == 1 and sum(map(len, frames_)) == 600
    monkeypatch.setattr(chunking, "FRAME", 100)
    assert max(len(f) for f in job[0](iter([texts]))) < 20


def test_markdown_chunks_come_in_small_frames(spark, monkeypatch):
    """what a worker holds of its output grows with a frame, not with a batch of long sections."""
    docs, job = spark.createDataFrame([(0, "a")], "doc long, text string"), []
    monkeypatch.setattr(type(docs), "mapInPandas", lambda self, run, schema: job.append(run))
    monkeypatch.setattr(chunking, "_indexed", lambda rows, order: rows)
    chunking.markdown(docs, 40, 5)
    monkeypatch.setattr(chunking, "FRAME", 1_000, raising=False)
    batch = pd.DataFrame({"doc": range(200), "section": 1, "path": "# a", "body": "one two three four five six seven eight nine ten"})
    frames_ = list(job[0](iter([batch])))
    assert len(frames_) > 5 and max(f["text"].str.len().sum() for f in frames_) < 1_100
    assert sorted({d for f in frames_ for d in f["doc"]}) == list(range(200)) and all((f["text"].str.len() <= 40).all() for f in frames_)


def test_profiles_do_not_sort_all_scores_by_combination(spark):
    """the few combinations in focus go to the scores, which stay where they are."""
    rows = [(f"c{i % 9}", m, (i % 9) / 10 + k) for i in range(900) for k, m in enumerate(("x", "y"))]
    scores = spark.createDataFrame(rows, "combo string, metric string, value double").repartition(3)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        profile = ranking.metric_profile(scores, ranking.focus(scores.groupBy("combo").agg(F.avg("value").alias("media")), 2))
        got = {r["metric"]: (round(r["top"], 9), round(r["bottom"], 9), round(r["gap"], 9)) for r in profile.collect()}
        plan = profile._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == {"x": (0.75, 0.05, -0.7), "y": (1.75, 1.05, -0.7)}
    assert "SortMergeJoin" not in plan


def test_row_means_are_dealt_to_more_tasks_the_more_rows_there_are(spark, monkeypatch):
    """also where result ids, questions or combinations occur more than once or are null."""
    monkeypatch.setattr(ranking, "TASK_ROWS", 50)
    rng = random.Random(19)
    pick = lambda *values: rng.choice([None, *values])
    rows = [(rng.randrange(300), pick("a", "b", "c"), pick(*range(7)), pick("s", "t"), pick(0.0, 0.25, 0.5), pick(0.125, 1.0)) for _ in range(1000)]
    results = spark.createDataFrame(rows, "result_id int, combo string, question int, question_type string, x double, y double")
    means = ranking.row_means(results, ("x", "y"))
    assert means.rdd.getNumPartitions() == 20
    values, levels = {}, {}
    for row in rows:
        values.setdefault(row[:4], []).extend(v for v in row[4:] if v is not None)
    for (_, combo, question, kind), v in values.items():
        for level, key in (("combo", (combo, None)), ("combo_type", (combo, kind)), ("type", (None, kind))):
            if v:
                levels.setdefault((level, *key), []).append((question, sum(v) / len(v)))
    assert sorted(r["media"] for r in means.collect()) == sorted(sum(v) / len(v) for v in values.values() if v)
    ranked = ranking.rank_combinations(means).collect()
    assert len(ranked) == len(levels) and ranked[0].asDict().keys() == {"combo", "question_type", "n", "questions", "media", "level", "place"}
    for r in ranked:
        asked = levels[r["level"], r["combo"], r["question_type"]]
        assert (r["n"], r["questions"]) == (len(asked), len({q for q, _ in asked} - {None}))
        assert abs(r["media"] - sum(m for _, m in asked) / len(asked)) < 1e-12
        assert r["place"] == 1 + sum(o["level"] == r["level"] and round(o["media"], 9) > round(r["media"], 9) for o in ranked)


def test_passages_are_found_word_for_word_without_a_shuffle_of_texts(spark, tmp_path, monkeypatch):
    """F16: also short and empty passages, those cut out of longer words, equal rows of texts, and several blocks of passages."""
    monkeypatch.setattr(retrieval, "MOST_ANCHORS", 2)
    passages = [None, "", "art", "art of", "rt  of MAKING br", "art of making bread by hand at hom", "of making bread", "a a", "a a a a a a", "not held by any", "ção é", "- of -"]
    texts = [None, "", "art", "A cart of making bread  by hand\nat home, twice: a cart of making bread by hand at home", "a a a a a a a a", "Ação é", "part of Making breads - of - all", "part of Making breads - of - all"]
    docs = spark.createDataFrame([(i, t, f"src{i % 4}") for i, t in enumerate(texts)], "doc long, text string, source string")
    found = retrieval.holding(spark.createDataFrame(list(enumerate(passages)), "id long, text string"), docs)
    key = lambda t: " ".join(t.split()).lower()
    want = sorted((i, d, f"src{d % 4}") for i, p in enumerate(passages) for d, t in enumerate(texts) if p is not None and t is not None and key(p) in key(t))
    assert found.columns == ["passage_id", "doc", "source"] and sorted(tuple(r) for r in found.collect()) == want and len(want) > 20
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()

    same = pd.DataFrame({"doc_id": [7, 7], "text": ["one two three"] * 2, "lang": "en", "source": "src0", "n_chars": 13})  # equal rows count twice
    pd.concat([same, pd.DataFrame({"doc_id": [8], "text": ["cart of making bread by hand at homes"], "lang": "en", "source": "src3", "n_chars": 36})]).to_parquet(tmp_path / "documents.parquet")
    pd.DataFrame({"item_id": [1, 2, 3], "text": ["one two three", "two", "art of making bread by hand at home"]}).to_parquet(tmp_path / "benchmark.parquet")
    with duckdb.connect() as con:
        for t in ("documents", "benchmark"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet')")
        for name in ("p12_question_audit", "p10_verbatim_evidence"):
            assert sorted(tuple(r) for r in registry.queries()[name](spark, str(tmp_path)).collect()) == sorted(con.execute(registry.sql()[name]).fetchall())


def test_intervals_pair_questions_once(spark, monkeypatch):
    """the comparison and the draws read one table of differences with their numbers."""
    paired, calls = comparison.paired_differences, []
    monkeypatch.setattr(comparison, "paired_differences", lambda *a: calls.append(a) or paired(*a))
    rng = random.Random(17)
    rows = [(c, 0, q, f"t{q % 2}", rng.choice([0.0, 0.25, 0.5, 1.0])) for c in ("a", "b", "c") for q in range(60) if c != "c" or q % 2]
    means = spark.createDataFrame(rows, "combo string, base int, question int, question_type string, value double")
    got = {(r["combo"], r["scope"]): r for r in comparison.compare_intervals(means, "b", 200).collect()}
    assert len(calls) == 1
    value = {(c, q): v for c, _, q, _, v in rows}
    assert got.keys() == {("a", "all"), ("a", "t0"), ("a", "t1"), ("c", "all"), ("c", "t1")}
    for (combo, scope), r in got.items():
        diffs = [v - value["b", q] for (c, q), v in value.items() if c == combo and scope in ("all", f"t{q % 2}")]
        assert r["n"] == len(diffs) and abs(r["mean_diff"] - sum(diffs) / len(diffs)) < 1e-12 and r["low"] <= r["mean_diff"] <= r["high"]


def made_of_words(rng, size):
    """Texts of ``size`` characters, of words of few syllables."""
    text = ""
    while len(text) < size:
        text += "".join(rng.choice("the an er on in th re ti es nd at en or is it ha ou se al to".split()) for _ in range(rng.choice((1, 2, 2, 3)))) + " "
    return text[:size]


def test_names_of_few_words_are_not_compared_all_with_all(monkeypatch):
    """Before, so many shared two segments that a cell looked at all its pairs."""
    rng = random.Random(21)
    one, two = (sorted({made_of_words(rng, size) for _ in range(9000)}) for size in (20, 22))
    for k in range(0, 9000, 5):
        two.append(one[k][:7] + "xy" + one[k][7:12] + one[k][13:] + "z")  # with neighbours
    fewer, plain = [], strings._all_pairs

    def counted(a, b, *more):
        for x, y in plain(a, b, *more):
            fewer.append(len(x))
            yield x, y

    monkeypatch.setattr(strings, "_all_pairs", counted)
    got = [strings.similar_in_cell(one, two, 85.0), strings.similar_in_cell(one, one, 85.0)]
    assert not fewer
    monkeypatch.setattr(strings, "_signed_pairs", lambda *_: None)
    for pair, x in zip(got, (strings.similar_in_cell(one, two, 85.0), strings.similar_in_cell(one, one, 85.0))):
        assert fewer and all((p == q).all() for p, q in zip(pair, x)) and len(x[0]) > 1000


def test_pieces_meet_every_pair_at_the_bound(monkeypatch):
    """Strings of all lengths whose operations lie anywhere, among them as many as there may be; signatures are met by small ranges."""
    monkeypatch.setattr(strings, "STEP", 10)
    rng, met = random.Random(22), 0
    for least in (85.0, 75.0):
        for m in range(1, strings.SEGMENTED + 1, 1 if least > 80 else 4):
            for n in range(m, strings.SEGMENTED + 1, 1 + m % 2):
                tau = strings.distance_bound(m, n, least)
                if tau < 0:
                    continue
                pairs = []
                for _ in range(12):
                    a = [rng.choice("abcde ") for _ in range(m)]
                    b = list(a)
                    for _ in range(rng.randint(0, (tau - n + m) // 2)):
                        del b[rng.randrange(len(b))]
                    while len(b) < n:
                        b.insert(rng.randint(0, len(b)), rng.choice("abcde "))
                    pairs.append(("".join(a), "".join(b)))
                one, two = (strings._Side([p[k] for p in pairs], size) for k, size in enumerate((m, n)))
                strings._fit_bags(one, two)
                found = set()
                for own, others in strings.ways(m, n, tau).items():
                    for part in range(2):
                        hashes = one.signed(*own, part, 2)
                        for other in others:
                            more = two.signed(*other, part, 2)
                            for x, y in strings._ranges(hashes, more):
                                found |= {(int(p), int(q)) for ps, qs in strings._met_rows(one, two, x, y, tau) for p, q in zip(ps, qs)}
                for x, (a, _) in enumerate(pairs):
                    for y, (_, b) in enumerate(pairs):
                        if 200 * lcs_length(a, b) >= least * (m + n):
                            met += 1
                            assert (x, y) in found, (a, b)
    assert met > 2000


def test_synonyms_of_both_ways_are_looked_for_once(spark, monkeypatch):
    """A pair's two ways come from one pass over the cells."""
    plans, plain = [], graph.written

    def noted(rows, name):
        plans.append(rows._jdf.queryExecution().optimizedPlan().toString())
        return plain(rows, name)

    monkeypatch.setattr(graph, "written", noted)
    rows = [("a", "Serra da Lajinha"), ("b", "Serra da Laginha"), ("c", "Outro nome")]
    got = {tuple(r) for r in graph.synonyms(spark.createDataFrame(rows, "key string, name string")).collect()}
    assert got == {("a", "b", 0.9375), ("b", "a", 0.9375)}
    assert max(p.count("FlatMapCoGroups") for p in plans) == 1

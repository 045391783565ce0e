import math
import random

import pytest
from pyspark.sql import functions as F

from ragbench.functions import similarity, text
from ragbench.operators import annotation, chunking, comparison, dialogue, graph, grid, metrics, prep, ranking, retrieval, signals, techniques
from ragbench.sources import tables
from ragbench.streaming import jobs


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_lcs_and_partial_ratio_match_plain_versions():
    rng = random.Random(0)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randrange(0, 14))) for _ in range(2))
        assert similarity.lcs_length(a, b) == lcs(a, b)
        s, t = sorted((a, b), key=len)
        windows = [t[max(0, i) : i + len(s)] for i in range(1 - len(s), len(t))]
        want = (100.0 if not t else 0.0) if not s else max(200 * lcs(s, w) / (len(s) + len(w)) for w in windows if w)
        assert abs(similarity.partial(a, b) - want) < 1e-9


def test_chi2_and_friedman(spark):
    assert abs(comparison.chi2_tail(33.34, 7) - 2.2880938893476784e-05) < 1e-15
    assert abs(comparison.chi2_tail(10, 5) - 0.07523524614651216) < 1e-12
    rows = [(f"i{k}", 0, q, v) for q, row in enumerate([[1, 0, 0], [1, 1, 0], [0.5, 0.2, 0.9]]) for k, v in enumerate(map(float, row))]
    got = comparison.friedman(spark.createDataFrame(rows, "combo string, base int, question int, value double"), ["i0", "i1", "i2"]).first()
    assert abs(got["chi2"] - 7 / 6) < 1e-9 and abs(got["p"] - 0.5580351457700471) < 1e-9 and got["questions"] == 3


def test_constant_differences_have_a_zero_width_interval(spark):
    rows = spark.createDataFrame([("a", q, 0.2) for q in range(4)], "item string, question int, diff double")
    for got in (comparison.percentile_interval(comparison.bootstrap_means(rows, "item", 50), "item", 50).first(), comparison.replay_interval(rows, "item", 50).first()):
        assert abs(got["low"] - 0.2) < 1e-9 and abs(got["high"] - 0.2) < 1e-9 and got["low"] > 0


@pytest.mark.parametrize("shard", [comparison.SHARD, 400])
def test_interval_widths_are_those_of_plain_resampling(spark, shard):
    import numpy as np

    rng = np.random.default_rng(5)
    values = {f"n{n}": rng.normal(0.1, 1, n) if n != 100 else rng.integers(0, 4, n) / 4 for n in (15, 40, 100, 1500)}
    rows = spark.createDataFrame([(k, q, float(x)) for k, v in values.items() for q, x in enumerate(v)], "item string, question int, diff double")
    draws = comparison.bootstrap_means(rows, "item", 10_000, shard=shard)
    got = {r["item"]: r for r in comparison.percentile_interval(draws, "item", 10_000).collect()}
    for k, v in values.items():
        plain = np.sort(v[rng.integers(0, len(v), (10_000, len(v)))].mean(1))
        want = plain[9749] - plain[250]
        assert abs(got[k]["high"] - got[k]["low"] - want) < 0.06 * want and abs(got[k]["low"] - plain[250]) < 0.1 * want
    assert draws.count() == 40_000 and draws.select("item", "rep").distinct().count() == 40_000


def test_kappa_interval_is_that_of_plain_resampling(spark):
    import numpy as np

    rng = np.random.default_rng(6)
    x = rng.integers(0, 3, 300)
    y = np.where(rng.random(300) < 0.7, x, rng.integers(0, 3, 300))
    rows = spark.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(zip(x, y))], "item int, x int, y int")
    got = annotation.bootstrap_kappa(rows, weights="quadratic").first()
    draws = []
    for _ in range(4000):
        at = rng.integers(0, 300, 300)
        a, b = x[at], y[at]
        draws.append(1 - ((a - b) ** 2).mean() / ((a[:, None] - b[None]) ** 2).mean())
    low, high = np.quantile(draws, [0.025, 0.975])
    assert abs(got["low"] - low) < 0.02 and abs(got["high"] - high) < 0.02


def test_comparison_lists_types_and_other_bases(spark):
    rows = [("b", 0, q, 0.5, "t1" if q < 4 else "t2") for q in range(8)] + [("x", 0, q, 0.5 + 0.1 * (q % 2), "t1") for q in range(6)] + [("y", 1, q, 0.25 * q, "t1") for q in range(3)] + [("z", 0, 99, 1.0, "t1")]
    means = spark.createDataFrame(rows, "combo string, base int, question int, value double, question_type string")
    got = {(r["combo"], r["scope"]): r for r in comparison.compare_intervals(means, "b", 500).collect()}
    assert {k: r["n"] for k, r in got.items()} == {("x", "all"): 6, ("x", "t1"): 4, ("x", "t2"): 2}
    assert all(r["low"] <= r["mean_diff"] <= r["high"] for r in got.values())
    other = comparison.other_base_intervals(means, "b", 500).collect()
    assert [(r["combo"], r["n"], r["mean"]) for r in other] == [("y", 3, 0.25)] and other[0]["low"] <= 0.25 <= other[0]["high"]
    assert [r["combo"] for r in comparison.without_common(means, "b").collect()] == ["z"]


def test_krippendorff_published_values(spark):
    table = [[1, 2, 3, 3, 2, 1, 4, 1, 2, None, None, None], [1, 2, 3, 3, 2, 2, 4, 1, 2, 5, None, 3], [None, 3, 3, 3, 2, 3, 4, 2, 2, 5, 1, None], [1, 2, 3, 3, 2, 4, 4, 1, 2, 5, 1, None]]
    rows = spark.createDataFrame([(u, f"r{r}", "d", table[r][u]) for r in range(4) for u in range(12)], "item int, annotator string, dim string, score int")
    for level, want in (("nominal", 0.743), ("ordinal", 0.815), ("interval", 0.849)):
        assert abs(annotation.krippendorff(rows, ["dim"], level).first()["alpha"] - want) < 5e-4


def test_kappa(spark):
    rows = spark.createDataFrame([(i, "d", x, y) for i, (x, y) in enumerate(zip([0, 1, 2, 2], [0, 2, 2, 1]))], "item int, dim string, x int, y int")
    assert abs(annotation.kappa(rows, ["dim"], "quadratic").first()["kappa"] - 7 / 11) < 1e-9


def test_allocation_gives_the_shortfall_to_others(spark):
    pool = spark.createDataFrame([(s,) for s, n in (("a", 1), ("b", 9), ("c", 5)) for _ in range(n)], "s string")
    equal = {r["s"]: (r["target"], r["allocated"], r["short"]) for r in annotation.allocate(pool, "s", 10).collect()}
    assert equal == {"a": (4, 1, True), "b": (3, 5, False), "c": (3, 4, False)}
    share = {r["s"]: r["allocated"] for r in annotation.allocate(pool, "s", 7, "proportional").collect()}
    assert sum(share.values()) == 7 and share == {"a": 1, "b": 4, "c": 2}


def test_rasch_orders_questions(spark):
    cells = spark.createDataFrame([("all", p, q, y) for p in ("x", "y") for q, y in (("easy", 1.0), ("mid", 0.5), ("hard", 0.0))], "scope string, person string, question string, y double")
    b = {r["question"]: r["difficulty"] for r in signals.rasch(cells).collect()}
    assert b["hard"] > b["mid"] > b["easy"] and abs(sum(b.values())) < 1e-9


def test_rouge_matches_plain_lcs(spark):
    rows = [(1, "o gato preto dorme", "o gato dorme aqui"), (2, "nada", "igual"), (3, "", "x"), (4, "x", None)]
    got = {r[0]: r[1] for r in metrics.rouge_l(spark.createDataFrame(rows, "id int, answer string, reference string")).collect()}
    assert got == {1: pytest.approx(0.75), 2: 0.0, 3: 0.0}


def test_evidence_matching(spark):
    rows = [("A **Igreja** Matriz, de 1890!", "a igreja matriz de 1890 fica no centro da cidade", True), ("uma passagem bem longa que o trecho nao tem", "trecho", False), ("", "x", False), (None, "x", False)]
    got = spark.createDataFrame(rows, "e string, c string, want boolean").select(metrics.found_in(F.col("e"), F.col("c")).alias("got"), "want").collect()
    assert all(r["got"] == r["want"] for r in got)


def test_key_facts(spark):
    rows = [
        (1, "1.200 reais", "custa 1200"), (1, "dia 05", "no dia 5 de maio"), (2, "praça central", "na Praca Centrall hoje"), (3, "7 km", "são 8 km"), (4, "30 km", "leva 30 minutos"), (5, "6.775 habitantes", "tem 6775 Habitantes"),
        (6, "30 m", "fica a 30 metros"), (7, "2,5 km", "são 12,5 km"), (8, "8 h", "abre às 8:00"), (9, "840 m²", "ocupa 840 metros quadrados"),
    ]
    got = {r["id"]: r["leak"] for r in metrics.leakage_class(metrics.key_facts(spark.createDataFrame(rows, "id int, fact string, answer string"))).collect()}
    assert got == {1: "all", 2: "all", 3: "none", 4: "none", 5: "all", 6: "all", 7: "none", 8: "all", 9: "all"}


def test_chunkers_on_edge_texts(spark):
    docs = spark.createDataFrame([(1, "a" * 2500), (2, ""), (3, None), (4, "One. Two! Three?\n\n" + "word " * 600)], "doc long, text string")
    fixed = chunking.fixed(docs).where("doc = 1").orderBy("chunk_index").collect()
    assert [len(r["text"]) for r in fixed] == [1000, 1000, 700]
    for name, chunker in chunking.CHUNKERS.items():
        rows = chunker(docs).collect()
        assert rows and all(r["text"].strip() for r in rows) and {r["doc"] for r in rows} <= {1, 4}, name
        assert sorted(r["chunk_index"] for r in rows if r["doc"] == 4) == list(range(sum(r["doc"] == 4 for r in rows)))
    assert all(len(r["text"]) <= 1000 for r in chunking.recursive(docs).collect())
    md = spark.createDataFrame([(1, "# A\n## B\nx\n```\n# no\n```\n# C\ny\n## D")], "doc long, text string")
    assert [(r["path"], r["body"]) for r in chunking.markdown_sections(md).orderBy("section").collect()] == [("# A\n## B", "x\n```\n# no\n```"), ("# C", "y")]


def test_retrievers(spark):
    chunks = spark.createDataFrame([(i, "a", i, [1.0, 0.01 * i], f"c{i}") for i in range(30)], "chunk_id long, doc string, chunk_index int, vector array<double>, text string")
    question = spark.createDataFrame([(1, [1.0, 0.15])], "qid long, vector array<double>")
    hit = retrieval.top_k(question, chunks, 1).join(chunks.select("chunk_id", "doc", "chunk_index"), "chunk_id")
    assert retrieval.parent_document(hit, chunks).first()["text"] == "c14 c15 c16"
    three = spark.createDataFrame([(0, [1.0, 0.0, 0.0]), (1, [0.95, 0.05, 0.0]), (2, [0.0, 1.0, 0.0])], "chunk_id long, vector array<double>")
    ask = spark.createDataFrame([(1, [1.0, 0.1, 0.0])], "qid long, vector array<double>")
    assert [r["chunk_id"] for r in retrieval.mmr(ask, three, 2, 3, 0.1).orderBy("rank").collect()] == [1, 2]
    assert retrieval.top_k(ask, three.limit(0), 3).count() == 0


def test_approximate_search_recall(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))
    c = e.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    pairs = lambda x: {(r["qid"], r["chunk_id"]) for r in x.collect()}
    exact, near = pairs(retrieval.top_k(q, c, 10)), pairs(retrieval.approximate_top_k(q, c, 10))
    assert len(near) == len(exact) and len(exact & near) / len(exact) >= 0.9
    few = pairs(retrieval.approximate_top_k(q.limit(3), c.limit(7), 10))
    assert len(few) == 21 and retrieval.approximate_top_k(q, c.limit(0), 10).count() == 0


def test_graph_retrieval_of_a_small_graph(spark):
    entities = spark.createDataFrame([("a", "A", [1.0, 0.0, 0.0], [1, 2]), ("b", "B", [0.0, 1.0, 0.0], [2]), ("c", "C", [0.0, 0.0, 1.0], [3]), ("d", "D", [0.0, -1.0, 0.0], [9])], "key string, name string, vector array<double>, chunk_ids array<int>")
    relations = spark.createDataFrame([(1, "a", "b", "near", [1.0, 0.0, 0.0], [2]), (2, "c", "a", "far", [0.0, 0.0, 1.0], [3])], "relation_id int, source string, target string, description string, vector array<double>, chunk_ids array<int>")
    links = spark.createDataFrame([("a", "d", 0.9), ("d", "a", 0.9)], "key string, other string, weight double")
    chunks = spark.createDataFrame([(1,), (2,), (3,)], "chunk_id int")
    ask = spark.createDataFrame([(7, [1.0, 0.0, 0.0])], "qid int, vector array<double>")
    contexts, found, shown = graph.graph_retrieve(ask, entities, relations, links, chunks, 1, 1, 5)
    spec = lambda n: math.log(4 / n) / math.log(4)
    a = spec(2)
    want = {1: a, 2: a + 0.5 * a * spec(1) + math.sqrt(spec(2) * spec(1)), 3: 0.5 * a * spec(1)}  # chunk 9 is not there
    got = {r["chunk_id"]: (r["rank"], r["score"]) for r in contexts.collect()}
    assert {k: v[0] for k, v in got.items()} == {2: 1, 1: 2, 3: 3} and all(abs(got[k][1] - v) < 1e-9 for k, v in want.items())
    assert [r["text"] for r in found.orderBy("n").collect()] == ["a → b: near", "c → a: far"]
    assert [(r["name"], r["hop"]) for r in shown.orderBy("place").collect()] == [("A", 0), ("D", 1), ("B", 1), ("C", 1)]


def test_gate_counts_aliases_and_undirected_pairs(spark):
    found = spark.createDataFrame([("s", "Cachoeira do Dedi"), ("s", "Igreja Matriz (velha)"), ("s", "Nada disso")], "section string, name string")
    rel = spark.createDataFrame([("s", "igreja matriz", "Cachoeira do Dédi"), ("s", "Nada disso", "Igreja Matriz")], "section string, source string, target string")
    key = spark.createDataFrame([("s", 0, ["Cachoeira do Deosdédi", "Cachoeira do Dédi"]), ("s", 1, ["Igreja Matriz"]), ("s", 2, ["Praça"])], "section string, entity int, names array<string>")
    got = graph.gate(found, rel, key, spark.createDataFrame([("s", 0, 1), ("s", 1, 2)], "section string, a int, b int")).where("section is null").first()
    assert (got["entities_gold"], got["entities_found"], got["entities_predicted"], got["entities_correct"]) == (3, 2, 3, 2)
    assert (got["relations_gold"], got["relations_found"], got["relations_predicted"], got["relations_correct"]) == (2, 1, 2, 1) and got["passed"]


def test_graphs_load_only_when_complete(spark, tmp_path):
    path = f"file://{tmp_path}/g"
    e, r = spark.createDataFrame([("a", "A", "x")], "key string, name string, description string"), spark.createDataFrame([("a", "b", "k", "d")], "source string, target string, keywords string, description string")
    assert tables.load_graph(spark, path) is None
    e, r = tables.graph_texts(e, r)
    assert e.first()["text"] == "A: x" and r.first()["text"] == "k a b d"
    tables.write_graph(e, r, spark.createDataFrame([(1,)], "n int"), path)
    assert [x.count() for x in tables.load_graph(spark, path)] == [1, 1]


def test_compressed_contexts_have_no_retrieval_signals(spark):
    hits = spark.createDataFrame([(1, 0.9, "doc"), (1, 0.5, "doc"), (2, 1.0, "compression")], "qid int, score double, source string")
    assert [r["qid"] for r in signals.retrieval_signals(hits).collect()] == [1]


def test_names_are_registered_once():
    from ragbench.plans import named

    assert named.get("chunkers", "fixed") is chunking.fixed and {"graph", "naive"} <= named.REGISTERED["techniques"].keys()
    with pytest.raises(KeyError):
        named.get("metrics", "none")
    with pytest.raises(ValueError):
        named.register("chunkers", "fixed", len)


def test_rank_correlation_interval_is_that_of_plain_resampling(spark):
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(3)
    x = rng.integers(0, 3, 120)
    y = x + rng.normal(0, 1.5, 120)
    rows = spark.createDataFrame([("g", int(a), float(b)) for a, b in zip(x, y)], "g string, x int, y double")
    got = annotation.spearman_interval(rows, ["g"], "x", "y").first()
    draws = []
    for _ in range(2000):
        at = rng.integers(0, 120, 120)
        draws.append(np.corrcoef(pd.Series(x[at]).rank(), pd.Series(y[at]).rank())[0, 1])
    low, high = np.quantile(draws, [0.025, 0.975])
    assert abs(got["low"] - low) < 0.03 and abs(got["high"] - high) < 0.03


def test_graph_parsing_and_merging(spark):
    reply = "1. entidade<|>Igreja Matriz (Matriz)<|>Lugar<|>antiga\n(entidade<|>'Festa'<|>Evento<|>de maio)\nrelacao<|>Festa<|>Matriz<|>onde<|>acontece na\nrelacao<|>Festa<|>9 de maio<|>quando<|>x\nrelacao<|>Festa<|>Prefeitura<|>org<|>organiza\nqualquer coisa\n<|FIM|>"
    lines = graph.parse_replies(spark.createDataFrame([(1, reply), (2, "entidade<|>Matriz<|>Organização<|>")], "chunk_id int, reply string"))
    assert {r["kind"]: r["n"] for r in lines.groupBy("kind").agg(F.count("*").alias("n")).collect()} == {"entity": 3, "relation": 3, "failed": 1}
    entities = graph.merge_entities(lines)
    got = {r["key"]: r for r in entities.collect()}
    assert set(got) == {"igreja matriz", "festa"} and got["igreja matriz"]["chunk_ids"] == [1, 2] and got["igreja matriz"]["type"] == "lugar"
    relations, promoted = graph.merge_relations(lines, entities)
    assert {(r["source"], r["target"]) for r in relations.collect()} == {("festa", "igreja matriz"), ("festa", "prefeitura")}
    assert [r["key"] for r in promoted.collect()] == ["prefeitura"]


def test_synonyms_match_all_pairs(spark):
    names = ["Cachoeira do Dédi", "Cachoeira do Dedi", "Cachoeira do Rio", "Praça Central", "Praca Centrau", "Igreja", "Igrejas", "Rio"]
    got = {(r["key"], r["other"]) for r in graph.synonyms(spark.createDataFrame([(str(i), n) for i, n in enumerate(names)], "key string, name string")).collect()}
    import unicodedata

    plain = ["".join(c for c in unicodedata.normalize("NFKD", n.lower()) if not unicodedata.combining(c)) for n in names]
    want = {(str(i), str(j)) for i, a in enumerate(plain) for j, b in enumerate(plain) if i != j and 200 * lcs(a, b) / (len(a) + len(b)) >= 85}
    assert got == want


def test_headings_and_hub(spark):
    row = spark.createDataFrame([("# A\n\n## B\nbody\n# not", "Hotel Sol em São João", "Praça, São João", "São João")], "t string, a string, b string, c string")
    hub = F.lit("sao joao")
    got = row.select(graph.without_headings(F.col("t")).alias("t"), *(graph.strip_hub(F.col(c), hub).alias(c) for c in "abc")).first()
    assert tuple(got) == ("body\n# not", "Hotel Sol", "Praça", "São João")


def test_techniques(spark):
    got = spark.createDataFrame([("2, 0 e 2", 3), ("nada", 2), ("9", 0)], "r string, n int").select(techniques.parsed_ranking(F.col("r"), F.col("n")).alias("x")).collect()
    assert [r["x"] for r in got] == [[2, 0, 1], [0, 1], []]
    replies = spark.createDataFrame([("DIRECT oi",), ("RAG: onde fica?",), ("\"Onde fica?\"",), ("não sei",), (None,)], "r string")
    assert [tuple(r) for r in replies.select(*dialogue.triage(F.col("r"))).collect()] == [("direct", ""), ("rag", "onde fica?"), ("rag", "Onde fica?"), ("rag", ""), ("rag", "")]


def test_pareto_matches_all_pairs(spark):
    rng = random.Random(5)
    pts = [(i, float(rng.randrange(40)), float(rng.randrange(40))) for i in range(300)]
    got = {r[0] for r in ranking.pareto(spark.createDataFrame(pts, "id int, cost double, quality double")).collect()}
    assert got == {i for i, c, q in pts if not any((c2 <= c and q2 >= q and (c2 < c or q2 > q)) for _, c2, q2 in pts)}


def test_grid_runs_each_technique_on_what_it_reads(spark):
    values = lambda name, items: spark.createDataFrame([(v, i) for i, v in enumerate(items)], f"{name} string, no int")
    indexes = spark.createDataFrame([("fixed", "e5", 0), ("token", "e5", 1)], "chunking string, embedding string, no int")
    out = grid.expand(values("llm", ["a", "b"]), indexes, values("rag", ["naive", "closed_book"]), values("retriever", ["sim", "mmr"]))
    assert out.count() == 2 * (2 * 2 + 1) and out.where("rag = 'closed_book' and (retriever <> 'sim' or chunking <> 'fixed')").count() == 0


def test_question_files(spark, tmp_path):
    path = tmp_path / "q.csv"
    path.write_text('pergunta,evidencia_referencia,evidencia_salto,tipo\n"Onde, fica?",a | b,1|2,ponte\n ,x,,\nQuem?,a,1|2,\nComo?,,,outro\n', encoding="utf-8")
    got = {r["question"]: (r["question_type"], len(r["evidence"]), r["error"] is None) for r in tables.parse_questions(tables.read_questions(spark, str(path))).collect()}
    assert got["Onde, fica?"] == ("ponte", 2, True) and not got["Quem?"][2] and not got["Como?"][2] and len(got) == 3


def test_dumps_csv_and_append(spark, tmp_path):
    for i, body in enumerate(('[{"a": 1}, {"a": 2}]', '{"results": [{"a": 3}]}', '{"c1": {"q1": {"a": 4}}}')):
        (tmp_path / f"d{i}.json").write_text(body)
    rows = tables.explode_dump(spark, str(tmp_path / "d*.json")).collect()
    assert len(rows) == 4 and ("c1", "q1") in {(r["combo"], r["question"]) for r in rows}
    tables.write_csv(spark.createDataFrame([("=1+1", 2)], "x string, y int"), str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).first()["x"] == "'=1+1"
    chunk = spark.createDataFrame([("b", "fixed", "e5", "d", 0, "t")], "base string, chunking string, embedding string, doc string, chunk_index int, text string")
    for _ in range(2):
        known = spark.read.parquet(str(tmp_path / "ix")) if (tmp_path / "ix").exists() else None
        tables.append_chunks(tables.numbered(chunk, known), str(tmp_path / "ix"))
    assert sorted(r["chunk_id"] for r in spark.read.parquet(str(tmp_path / "ix")).collect()) == [0, 1]


def test_preparation(spark):
    pages = spark.createDataFrame([("d", p, f"Guia {p}\nA cida-\nde é boa\ne grande.\nNova frase.\n{p}") for p in range(1, 5)], "doc string, page int, text string")
    lines = prep.page_lines(pages)
    assert {r["mask"] for r in prep.running_lines(lines).collect()} >= {"Guia #", "#"}
    kept = prep.without_running_lines(lines, spark.createDataFrame([("d", "Guia #"), ("d", "#")], "doc string, mask string"))
    assert prep.join_wrapped(kept).orderBy("para").first()["text"] == "A cidade é boa e grande."
    packed = prep.pack(spark.createDataFrame([("d", i, "x" * 300) for i in range(5)], "doc string, para long, text string")).orderBy("block").collect()
    assert [len(r["text"]) for r in packed] == [601, 601, 300]


def test_accents_match_unicode(spark):
    import unicodedata

    samples = ["Ação é ÜBER ñandú", "São João", "é", "ﬀ œ ß"]
    got = [r[0] for r in spark.createDataFrame([(s,) for s in samples], "s string").select(text.strip_accents(F.col("s"))).collect()]
    for s, g in zip(samples[:3], got):
        assert g == "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))


def test_streams(spark, tmp_path):
    rows = [(1, i, f"2024-01-01 00:0{i}:00", i not in (2, 3, 4)) for i in range(7)] + [(1, 9, "2024-01-01 02:00:00", True), (2, 8, "2024-01-01 00:00:00", False)]
    events = spark.createDataFrame(rows, "experiment long, event_id long, t string, ok boolean").withColumn("ts", F.to_timestamp("t")).drop("t")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))

    def drain(frame, name):
        query = frame.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination(120)
        return spark.table(name).collect()

    assert [tuple(r) for r in drain(jobs.failure_streaks(stream), "streaks")] == [(1, 4)]
    assert {(r["experiment"], r["n"]) for r in drain(jobs.stalls(stream, "600 seconds", "1 minute"), "stalls")} >= {(1, 7)}
    assert {(r["experiment"], r["event_id"]) for r in jobs.stalls_batch(events).collect()} == {(1, 6), (1, 9), (2, 8)}
    docs = spark.createDataFrame([(1, "um texto", "2024-01-01"), (1, "um texto", "2024-01-01"), (2, "outro", "2024-01-01")], "doc long, text string, t string").withColumn("ts", F.to_timestamp("t")).drop("t")
    docs.coalesce(1).write.parquet(str(tmp_path / "docs"))
    job = jobs.ingest_stream(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "docs")), str(tmp_path / "out"), str(tmp_path / "cp"), chunking.fixed)
    job.awaitTermination(120)
    assert sorted(r["doc"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]


def test_pair_summary_matches_closed_forms(spark):
    notes = spark.createDataFrame([("a", w) for w in ["1"] * 7 + ["2"] * 2 + ["tie"]] + [("b", "tie")], "annotator string, winner string")
    got = {r["annotator"]: r for r in annotation.pair_summary(notes).collect()}
    p = 2 * sum(math.comb(9, i) for i in range(3)) / 2**9
    assert abs(got["a"]["p"] - p) < 1e-9 and got["b"]["p"] is None and got[None]["ties"] == 2


def test_short_texts_are_found_inside_longer_ones(spark):
    left = spark.createDataFrame([(1, "quick brown fox jumps over"), (2, "fox"), (3, "one two three four five six seven eight nine"), (4, "absent words")], "id long, text string")
    right = spark.createDataFrame([(10, "The quick brown fox jumps over the lazy dog again"), (11, "zero one two three four five six seven eight nine"), (12, "fox"), (13, None)], "id long, text string")
    got = sorted(tuple(r) for r in retrieval.shared_shingles(left, right).collect())
    assert got == [(1, 10, 1), (2, 10, 1), (2, 12, 1), (3, 11, 2)]
    assert retrieval.shared_shingles(left.limit(0), right).count() == 0


def test_chunks_of_long_texts_are_not_taken_for_those_of_the_next(spark, tmp_path):
    import __spark_entry__

    passage = "a passage of more than eight words that stands in two of the documents"
    rows = [(1, "x" * 900_200 + " " + passage + " " + "y" * 5000, "en"), (2, passage, "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, passage), (8, "stands in two")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = __spark_entry__.queries()["v7_shared_runs"](spark, str(tmp_path)).collect()
    # The passage is in chunk 1,000 of the first document and in chunk 0 of the second.
    for qid in (7, 8):
        assert sorted(r["rank"] for r in got if r["qid"] == qid) == [1, 2]


def test_streak_alerts_read_a_folder_of_part_files(spark, tmp_path):
    import __spark_entry__

    query, sf = __spark_entry__.queries()["w2_streak_alerts"], "/root/testdata/sf0.001"
    spark.read.parquet(f"{sf}/events.parquet").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    want = sorted(tuple(r) for r in query(spark, sf).collect())
    assert want and sorted(tuple(r) for r in query(spark, str(tmp_path)).collect()) == want

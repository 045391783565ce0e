import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from ragbench.llm import quality
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_pipeline_matches_brute_force(spark):
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    seen = {i: quality.measure(t) for i, t in docs.items()}
    codes = {i: quality.encode(quality.votes(r)) for i, (c, r) in seen.items() if c["n_words"]}
    patterns, counts = np.unique(list(codes.values()), return_counts=True)
    share, odds = quality.fit(patterns, counts.astype(float), len(quality.RULES))

    def good(i):
        n, _, _, _, repeated = brute.counts(docs[i])
        if n < 10 or 100 * repeated > 20 * n:
            return False
        vote = quality.decode(np.array([codes[i]]), len(quality.RULES))[0]
        return np.log(share / (1 - share)) + sum(odds[k, v + 1] for k, v in enumerate(vote)) >= 0

    kept = {i: t for i, t in docs.items() if good(i)}
    short = brute.dedup_lines(sorted(kept.items()))
    kept = {i: t for i, t in short.items() if t == kept[i] or brute.WORD.search(t)}
    kept = {i: kept[i] for i, (_, c) in brute.components(sorted(kept.items()), 5).items() if i == c}
    bad = brute.contamination(sorted(kept.items()), items)
    kept = {i: t for i, t in kept.items() if not bad[i][3]}
    out = corpus_pipeline.run(spark, SF)
    assert out.columns[: len(columns)] == columns
    assert {r["doc_id"]: r["text"] for r in out.collect()} == kept
    assert 0 < len(kept) < len(docs)


EXTRA = ("kept", "posterior", "contaminated", "n_lines", "component_id", "n_words", "id", "lines", "m")


def test_stages_take_edge_tables_and_columns_of_any_name(spark):
    run = "\n".join(f"line {i} of a passage that is repeated in some of the documents of this table" for i in range(6))
    prose = "The mill by the river has ground flour for the town since the old bridge was built and nobody recalls when that was."
    texts = [(1, None), (2, ""), (3, prose), (3, prose), (None, prose), (4, f"{prose}\n{run}"), (5, f"{run}\n{prose} Again."), (6, run), (7, " ".join(f"word{i % 701}x{i}" for i in range(20_000))), (8, "!!! ### $$$")]
    rows = [(i, t, None, "s", *(f"{c}-{k}" for c in EXTRA)) for k, (i, t) in enumerate(texts)]
    schema = ", ".join(["doc_id long", "text string", "lang string", "source string", *(f"`{c}` string" for c in EXTRA)])
    table = spark.createDataFrame(rows, schema)
    values = {r["kept"].split("-")[1]: r for r in table.collect()}
    for n_chars in (False, True):
        docs = table.withColumn("n_chars", F.length("text").cast("long")) if n_chars else table
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            assert out.columns[: len(docs.columns)] == docs.columns, name
            got = out.collect()
            assert stage(spark, docs.limit(0), SF).count() == 0, name
            for r in got:
                whole = values[r["kept"].split("-")[1]]
                assert all(r[c] == whole[c] for c in (*EXTRA, "doc_id", "source")), name
                if n_chars and r["text"]:
                    assert r["n_chars"] == len(r["text"]), name
            ids = sorted((r["doc_id"] or 0) for r in got)
            if name in ("decontamination", "mixing"):
                assert ids == [0, 1, 2, 3, 3, 4, 5, 6, 7, 8]
            if name == "line_dedup":
                assert ids == [0, 1, 2, 3, 3, 4, 5, 7, 8] and {r["text"] for r in got if r["doc_id"] == 5} == {f"{prose} Again."}
            if name == "near_dedup":
                assert ids == [0, 1, 2, 3, 3, 4, 6, 7, 8]  # 5 has the lines of 4 in another order
            if name == "quality_rules":
                assert set(ids) <= {0, 3, 4, 5, 6, 7} and ids.count(3) == 2

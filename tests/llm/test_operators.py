import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ragbench.llm import contamination, language, licenses, line_dedup, mixing, near_dup, quality, secrets, toxicity, warc
from tests.llm import brute

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 997}x{i}" for i in range(30_000))
RUN = "\n".join(f"line {i} of a passage that is repeated in some of the documents here" for i in range(6))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double, spans string, block string, n_words string"
ROWS = [
    (1, None), (2, ""), (3, "word"), (4, LONG), (5, "a b c d e f g h i j k l"), (6, "a b c d e f g h i j k l"), (6, "a b c d e f g h i j k l"), (None, "text without an id"),
    (7, " \t\n "), (8, f"one\n{RUN}\ntwo"), (9, f"three\n{RUN}\n\nfour"), (10, 'x password = "abcdefgh12" ção AKIAABCDEFGHIJKL01 ' + "ab12" * 9), (11, "1234 5678 !!"),
]


@pytest.fixture(scope="module")
def edge(spark):
    rows = [(i, t, "en" if i != 3 else None, "s" if i != 5 else None, 1, False, 9.0, "x", "y", "z") for i, t in ROWS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(edge):
    return edge.limit(0)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def pairs(docs):
    return [(r[0], r[1]) for r in docs.select("doc_id", "text").collect()]


def labels_of(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def test_every_operator_takes_edge_and_empty_tables(spark, edge, empty, monkeypatch):
    monkeypatch.setattr(language, "STEPS", 20)
    items = spark.createDataFrame([(1, "a b c"), (2, None), (None, "k l"), (3, "")], "item_id long, text string")
    labels = labels_of(spark, [(5, 1, 1), (6, 0, None), (6, 1, 0)])
    calls = [
        lambda d: toxicity.score_toxicity(d, labels), lambda d: language.identify(d), lambda d: quality.score_quality(d), lambda d: line_dedup.dedup_lines(d), lambda d: near_dup.near_duplicates(d),
        lambda d: mixing.mix(d), lambda d: secrets.find_secrets(d)[0], lambda d: contamination.contaminate(d, items),
    ]
    for call in calls:
        assert call(edge).count() == len(ROWS)
        assert call(empty).count() == 0
    paths = lambda d: d.withColumn("path", F.col("doc_id").cast("string"))
    assert licenses.scan_licences(paths(edge)).count() == len({i for i, _ in ROWS})
    assert licenses.scan_licences(paths(empty)).count() == 0


def test_toxicity_learns_and_ignores_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = {r["doc_id"]: r for r in toxicity.op1_toxicity(docs, labels).collect()}
    known = [(r["toxic"], got[r["doc_id"]]["score"]) for r in labels.collect() if not got[r["doc_id"]]["held_out"]]
    pos, neg = [s for t, s in known if t], [s for t, s in known if not t]
    assert np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg]) > 0.8
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r["doc_id"]: r["score"] for r in toxicity.op1_toxicity(docs, flipped).collect()}
    assert all(abs(again[i] - r["score"]) < 1e-12 for i, r in got.items())


def test_counterfactual_penalty_evens_out_identity_terms():
    from collections import Counter

    rng = random.Random(1)
    samples = [({b"idiot", b"muslim"} | {f"w{rng.randrange(50)}".encode() for _ in range(5)}, 1) for _ in range(60)]
    samples += [({b"christian"} | {f"w{rng.randrange(50)}".encode() for _ in range(5)}, 0) for _ in range(60)]
    swaps = Counter({b"muslim": 60, b"christian": 60})
    terms = [b"christian", b"idiot", b"muslim"]
    _, free = toxicity.fit(samples, swaps, terms, swap_weight=0.0)
    _, tied = toxicity.fit(samples, swaps, terms)
    gap = lambda w: abs(w[b"muslim"] - w[b"christian"])
    assert gap(tied) < 0.2 * gap(free) and tied[b"idiot"] > free[b"idiot"]


def test_swaps_do_not_change_scores_of_a_skewed_sample(spark):
    rng = random.Random(3)
    filler = lambda: " ".join(f"w{chr(97 + rng.randrange(26))}" for _ in range(6))
    rows = [(i, f"{'idiot' if i % 3 else ''} muslim people {filler()}.", 1) for i in range(0, 150)]
    rows += [(i, f"{'christian' if i % 2 else ''} people {filler()}.", 0) for i in range(150, 300)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    _, w = toxicity.learn(docs, labels)
    score = lambda t: sum(w.get(f, 0.0) for f in toxicity.features_of(t))
    for other in toxicity.IDENTITY_GROUPS[2]:
        assert abs(score("a muslim walked home") - score(f"a {other} walked home")) < 0.15
    assert w[b"idiot"] > 0.5
    assert toxicity.swaps_of("A muslim, many muslims. Women!") == [b"muslim ^musl ^musli", b"muslims ^musl ^musli", b"women"]


def test_language_gradients_and_accuracy(docs):
    model = language.ByteTagger(3, hidden=5, seed=3)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    seq, mask = language.padded([b"abc", b"zebra", b"q"])
    target, weight = np.eye(3)[[0, 2, 1]], np.ones(3)
    _, g = model.gradients(seq, mask, target, weight)
    for name in model.p:
        flat = model.p[name].reshape(-1)
        at = int(np.argmax(abs(g[name].reshape(-1))))
        old, eps = flat[at], 1e-4
        flat[at] = old + eps
        up = model.gradients(seq, mask, target, weight)[0]
        flat[at] = old - eps
        down = model.gradients(seq, mask, target, weight)[0]
        flat[at] = old
        assert abs((up - down) / (2 * eps) - g[name].reshape(-1)[at]) < 1e-4
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    out = [r for r in language.op3_language(docs).collect() if r["held_out"] and truth[r["doc_id"]]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in out]) > 0.9
    assert all(0 <= r["score"] <= 1 for r in out)


def test_language_undetermined(spark, edge, monkeypatch):
    monkeypatch.setattr(language, "STEPS", 20)
    got = {r["doc_id"]: r["lang_pred"] for r in language.op3_language(edge).collect()}
    assert got[1] == got[2] == got[7] == got[11] == "und"


def test_quality_counts_match_brute_force(docs, pairs):
    got = {r["doc_id"]: r for r in quality.op4_quality_rules(docs).collect()}
    for i, t in pairs:
        want = brute.counts(t)
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert got[i]["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (got[i]["base_failed"] and got[i]["kept"])


def test_quality_posterior():
    codes = np.array([quality.encode([1] * len(quality.RULES)), quality.encode([-1] + [1] * (len(quality.RULES) - 1))])
    share, odds = quality.fit(codes, np.array([900.0, 100.0]), len(quality.RULES))
    assert 0.5 < share < 1 and odds[0, 0] < 0 < odds[0, 2]
    assert quality.fit(np.zeros(0, dtype=np.int64), np.zeros(0), len(quality.RULES))[0] > 0.5
    assert (quality.decode(codes, len(quality.RULES))[1] == [-1] + [1] * (len(quality.RULES) - 1)).all()


def test_line_dedup_matches_brute_force(spark, pairs):
    small = [(i, t) for i, t in pairs if t is None or len(t) < 6000]
    small += [(9001, f"x\n{RUN}\ny"), (9002, f"{RUN}\n{RUN}"), (9003, f"{RUN}\nand {RUN}"), (9004, None), (9005, RUN.replace("\n", " \n\n"))]
    got = {r[0]: r[1] for r in line_dedup.dedup_lines(spark.createDataFrame(small, "doc_id long, text string")).select("doc_id", "text").collect()}
    assert got == brute.dedup_lines(small)
    assert got[9001] == f"x\n{RUN}\ny" and got[9002] == ""


def test_near_duplicates_match_brute_force(spark, docs, pairs):
    got = {r[0]: (r[1], r[2], r[3]) for r in near_dup.op6_near_duplicates(docs).collect()}
    assert got == {i: (n, c, i == c) for i, (n, c) in brute.components(pairs, 4).items()}


def test_near_duplicates_of_one_large_group(spark):
    """Copies that drift from their base: linked through one another, some with nothing."""
    rng = random.Random(4)
    base = [f"t{i}" for i in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randrange(0, 14)):
            words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    got = {r[0]: r[2] for r in near_dup.op6_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: c for i, (_, c) in brute.components(rows, 4).items()}


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 2**63, 900, dtype=np.uint64), rng.integers(0, 2**63, 300, dtype=np.uint64)
    x, y = a, np.concatenate([a[:600], b])
    assert (near_dup.merge(near_dup.registers(x), near_dup.registers(y)) == near_dup.registers(np.union1d(x, y))).all()
    j = near_dup.estimate(near_dup.registers(x)[None], near_dup.registers(y)[None], np.array([900.0]), np.array([900.0]))[0]
    assert abs(j - 0.5) < 0.15


def test_mixing_keeps_all_and_follows_targets(spark, docs):
    target = {r[0]: 1.0 for r in docs.select("source").distinct().collect()}
    rows = mixing.mix(docs, target=target, block_bytes=500).collect()
    assert len(rows) == docs.count()
    total = {}
    for r in sorted(rows, key=lambda r: (r["source"], r["place"])):
        assert r["place"] == total.get(r["source"], 0) and r["block"] == r["place"] // 500
        total[r["source"]] = r["place"] + max(1, len((r["text"] or "").encode()))
    # A plain schedule over all slots: at each the released block with the earliest deadline, ties as documented.
    k, blocks, given, want = len(total), {s: -(-n // 500) for s, n in total.items()}, dict.fromkeys(total, 0), {}
    for t in range(k * max(blocks.values())):
        ready = [(-(-(given[s] + 1) * k), str(s), s) for s in total if given[s] < blocks[s] and given[s] * k <= t]
        if ready:
            s = min(ready)[2]
            want[s, given[s]] = t
            given[s] += 1
    assert all(r["slot"] == want[r["source"], r["block"]] for r in rows)


def test_slots_follow_exact_weights_over_many_periods():
    for target in ({"a": 0.48523, "b": 0.51467, "c": 0.0001}, {f"d{i}": 1 + i % 7 / 3 for i in range(1500)}):
        w = mixing.weights(dict.fromkeys(target, 1), target, 1.0)
        blocks, total, sum_w = {s: 60_000 * x // sum(w.values()) + 1 for s, x in w.items()}, sum(target.values()), sum(w.values())
        assert all(abs(w[s] / sum_w - target[s] / total) < 1e-12 for s in target)
        end, taken = min(b * sum_w // w[s] for s, b in blocks.items()), set()
        for s, j, t in mixing.slots_of(w, blocks):
            assert t not in taken and j * sum_w // w[s] <= t < -(-(j + 1) * sum_w // w[s])
            taken.add(t)
        assert taken >= set(range(end)) and len(taken) == sum(blocks.values())


def test_mixing_takes_more_sources_than_a_thousand_and_keeps_the_target(spark):
    docs = spark.range(6000).selectExpr("id AS doc_id", "CASE WHEN id < 1500 THEN concat('d', id) WHEN id < 1510 THEN null ELSE concat('big', id % 2) END AS source", "repeat('x', 100) AS text")
    rows = mixing.mix(docs, block_bytes=100).collect()
    assert len(rows) == 6000 == len({r["slot"] for r in rows})
    sizes = {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + 100
    total = sum(float(n) ** 0.7 for n in sizes.values())
    for r in rows:
        share = sizes[r["source"]] ** 0.7 / total
        assert r["block"] / share - 1 < r["slot"] < (r["block"] + 1) / share + 1


def test_delivered_blocks_stay_within_one_of_the_true_targets():
    target = {"a": 0.12345, "b": 0.3333, "c": 0.0004, "d": 0.54285}
    w = mixing.weights(dict.fromkeys(target, 1), target, 1.0)
    total, given, n = sum(target.values()), dict.fromkeys(target, 0), 0
    for s, _, t in mixing.slots_of(w, {s: 10**9 for s in w}):
        assert t == n
        given[s] += 1
        n += 1
        if n % 997 == 0 or n < 5000:
            assert all(abs(given[x] - n * target[x] / total) < 1 for x in target)
        if n == 300_000:
            break


def test_mixing_rejects_bad_weights():
    for target in ({"a": 1, "b": 0}, {"a": 1}):
        with pytest.raises(ValueError):
            mixing.weights({"a": 1, "b": 1}, target, 1.0)


CLASHES = ("id", "cuts", "_id", "_key", "_gone", "_m", "_size", "_md5", "_range", "_held", "_p", "key", "hash", "doc", "lines", "size", "c0", "c1", "m", "p", "x")


def test_columns_of_any_name_come_back_unchanged(spark, monkeypatch):
    monkeypatch.setattr(language, "STEPS", 20)
    texts = [None, "", f"one two\n{RUN}", f"three\n{RUN}\nfour", "a b c d e f g h i j k l", "a b c d e f g h i j k l", "the quick brown fox"]
    rows = [(i, t, "en", f"s{i % 2}", *(f"{c}{i}" for c in CLASHES)) for i, t in enumerate(texts)]
    table = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", "lang string", "source string", *(f"`{c}` string" for c in CLASHES)]))
    items = spark.createDataFrame([("t1", "quick brown fox")], "item_id string, text string")
    labels = labels_of(spark, [(i, 1, i % 2) for i in range(7)])
    calls = (
        lambda d: toxicity.score_toxicity(d, labels), language.identify, quality.score_quality, line_dedup.dedup_lines, near_dup.near_duplicates, mixing.mix,
        lambda d: secrets.find_secrets(d)[0], lambda d: contamination.contaminate(d, items),
    )
    want = sorted((r[0], *r[4:]) for r in rows)
    for call in calls:
        got = call(table)
        assert got.columns[: len(table.columns)] == table.columns
        assert sorted(tuple(r) for r in got.select("doc_id", *(f"`{c}`" for c in CLASHES)).collect()) == want
    found = {r["doc_id"]: r["items"] for r in contamination.contaminate(table, items).collect()}
    assert found[6] == ["t1"] and not found[0]


def test_repeated_rows_and_ids(spark):
    rows = [(1, f"x\n{RUN}"), (1, f"x\n{RUN}"), (2, f"y\n{RUN}"), (2, f"y\n{RUN}"), (3, "a b c d e f g"), (3, "other words here stand alone now"), (4, "a b c d e f g"), (None, f"z\n{RUN}")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["text"], r["n_removed"]) for r in line_dedup.dedup_lines(table).collect())
    assert got[0] == (0, f"z\n{RUN}", 0) and got[1:5] == [(1, "x", 6)] * 2 + [(2, "y", 6)] * 2
    near = sorted(near_dup.near_duplicates(table).where("doc_id is not null").select("doc_id", "component_id", "kept").collect())
    assert len(near) == 7 and all(r["component_id"] <= r["doc_id"] for r in near) and len({(r[0], r[1]) for r in near}) == 4


def test_line_dedup_grows_in_proportion_to_equal_lines(spark):
    import time

    def took(n):
        table = spark.createDataFrame([(i, "\n".join(["the same line of eight words each time"] * n)) for i in (1, 2)], "doc_id long, text string")
        start = time.time()
        assert [r["n_removed"] for r in line_dedup.dedup_lines(table).orderBy("doc_id").collect()] == [n - 1, n]
        return time.time() - start

    took(200)
    assert took(16_000) < 3 * took(4_000) + 5


def test_mixing_without_ids_is_spread_over_ranges(spark):
    docs = spark.range(3000).selectExpr("cast(null AS long) AS doc_id", "'s' AS source", "concat('text ', id) AS text")
    assert mixing.mix(docs, block_bytes=1000).select("place").distinct().count() == 3000


def test_language_pools_every_byte_of_every_word():
    words = [b"abc", b"abd", b"xyz", "\u00e9t\u00e9".encode()]
    model = language.train(words, np.array([[3.0, 0], [2, 0], [0, 4], [1, 1]]), steps=5)
    text = "abc XYZ \u00e9t\u00e9 1 " + "\u00e9" * 40
    langs, scores = language.Pooler(model, ["l0", "l1"]).predict([text])
    logs = []
    for w in language.pieces_of(text):
        w.decode()  # no piece ends within a character
        logs += [np.maximum(x, np.log(language.FLOOR)) for x in model.log_probs(np.frombuffer(w, dtype=np.uint8)[None])[:, 0]]
    assert len(logs) == 3 + 3 + 5 + 80
    mean = np.mean(logs, axis=0, dtype=np.float64)
    p = np.exp(mean - mean.max()) / np.exp(mean - mean.max()).sum()
    assert langs == [["l0", "l1"][int(p.argmax())]] and abs(scores[0] - p.max()) < 1e-5


def test_language_keeps_a_rare_language(spark, monkeypatch):
    monkeypatch.setattr(language, "STEPS", 20)
    rows = [(i, " ".join(f"{chr(97 + (i * 7 + k) % 26)}{chr(97 + (i + k * 3) % 26)}ra" for k in range(60)), "aa") for i in range(300)] + [(1000 + i, "zuzu zozo zyzy", "zz") for i in range(6)]
    _, languages = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_pairs=20)
    assert languages == ["aa", "zz"]


def test_toxicity_scores_of_twins_are_close(spark):
    """Through the operator: one term goes with toxic labels, its twin with clean ones."""
    rng = random.Random(8)
    filler = lambda: " ".join(f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(6))
    rows = [(i, f"{filler()} idiot. My muslim {filler()}." if i % 2 == 0 else f"{filler()} nice. My christian {filler()}.", 1 - i % 2) for i in range(400)]
    twins = [(9000, "my muslim neighbour bakes bread"), (9001, "my christian neighbour bakes bread"), (9002, "my idiot neighbour bakes bread")]
    docs = spark.createDataFrame([r[:2] for r in rows] + twins, "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, labels_of(spark, [(r[0], 1, r[2]) for r in rows])).collect()}
    assert abs(got[9000] - got[9001]) < 0.05 and got[9002] > got[9000] + 0.2


def test_quality_verdicts_match_a_plain_label_model(docs, pairs):
    got = {r["doc_id"]: r for r in quality.op4_quality_rules(docs).collect()}
    want = brute.quality(dict(pairs))
    for i, p in want.items():
        if p is None:
            assert got[i]["posterior"] is None and not got[i]["kept"]
        else:
            assert abs(got[i]["posterior"] - p) < 1e-6
            assert got[i]["kept"] == (not got[i]["base_failed"] and p >= 0.5)


def test_licences_inherit_from_the_nearest_directory(spark):
    rows = [("a/LICENSE", licenses.TEMPLATES[0][1]), ("a/x.txt", "nothing"), ("a/b/y.txt", "text\nReleased under the MIT License.\nmore"), ("a/b/z.txt", None), ("c/q.txt", "licensed words under the sun"), (None, "x"), ("a/b/y2.txt", "a license of no kind")]
    got = {r["path"]: (r["licence"], r["origin"], r["source_dir"]) for r in licenses.scan_licences(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got["a/LICENSE"] == ("Apache-2.0", "header", None) and got["a/x.txt"] == ("Apache-2.0", "inherited", "a")
    assert got["a/b/y.txt"] == ("MIT", "header", None) and got["a/b/z.txt"] == ("MIT", "inherited", "a/b") and got["a/b/y2.txt"] == ("MIT", "inherited", "a/b")
    assert got["c/q.txt"] == (None, "none", None) and got[None] == (None, "none", None)


def test_real_licence_files_and_wrapped_headers_are_found(spark):
    mit = """MIT License

Copyright (c) 2021 Jane Roe

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
    apache = """#
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License.

import os
"""
    bsd = "/*\n * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions\n * are met:\n */\n\nint main;"
    rows = [("m/LICENSE", mit), ("m/src/a.c", "int x;"), ("p/run.py", apache), ("q/main.c", bsd), ("r/readme", "the software is a license to print money\nsaid the author"), ("m/src/b.c", None), ("m/src/c.c", "")]
    rows += [(f"z/{i}", f"a page about the use of software and documentation number {i} in the world of rights") for i in range(30)]
    got = {r["path"]: (r["licence"], r["origin"]) for r in licenses.scan_licences(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got["m/LICENSE"] == ("MIT", "header") and got["m/src/a.c"] == got["m/src/b.c"] == got["m/src/c.c"] == ("MIT", "inherited")
    assert got["p/run.py"] == ("Apache-2.0", "header") and got["q/main.c"] == ("BSD-3-Clause", "header") and got["r/readme"] == (None, "none") and got["z/3"] == (None, "none")


def test_secrets_match_brute_force_and_ledger_scans_once(spark, docs, pairs):
    extra = [(9001, "secret=token: abcdefghij"), (9002, "PassWord:'a' API_KEY = \"0123456789abcdef\" token==x=y=z=w"), (9003, "é token = ÿ AKIA0123456789AB AKIA" + "A" * 12 + " " + "f" * 31 + "g" + "0" * 40), (9004, None)]
    rows = pairs + extra
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in secrets.op9_secret_scan(frame).collect()}
    base = {i: ",".join(x for x in s.split(",") if x.split(":")[0] in ("assign", "access", "hex")) for i, s in got.items()}
    assert base == {i: brute.secrets(t) for i, t in rows}
    first, ledger = secrets.find_secrets(frame)
    again, fresh = secrets.find_secrets(frame.union(spark.createDataFrame([(1, "password=12345678")], frame.schema)), ledger)
    assert fresh.count() == 1 and again.where("size(spans) > 0").count() == first.where("size(spans) > 0").count() + 1
    assert secrets.find_secrets(frame, ledger, rule_version=2)[1].count() == ledger.count()


@pytest.mark.parametrize("block", [4000, contamination.BLOCK_WORDS])
def test_contamination_matches_brute_force(spark, docs, pairs, block):
    items = [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()] + [(900, "Short, item!"), (901, ""), (902, None)]
    rows = pairs + [(9001, "a SHORT item"), (9002, None)]
    frame = spark.createDataFrame(items, "item_id long, text string")
    got = contamination.contaminate(spark.createDataFrame(rows, "doc_id long, text string"), frame, block_words=block).collect()
    want = brute.contamination(rows, items)
    texts = dict(rows)
    for r in got:
        assert (r["n_words"], r["n_hit"], set(r["items"]), r["contaminated"]) == want[r["doc_id"]]
        inside = sum(len(brute.bench_words(texts[r["doc_id"]][a:b])) for a, b in r["spans"])
        assert inside == r["n_hit"]


def test_warc_round_trip_is_deterministic(spark, tmp_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    odd = spark.createDataFrame([(9001, None, None), (9002, "http://a b\r\nX: y", ""), (9003, "u", "é\r\n\r\nWARC/1.1"), (9004, "v", "é\r\n\r\nWARC/1.1"), (9004, "v", "é\r\n\r\nWARC/1.1"), (None, "w", "z" * 100_000)], "page_id long, url string, html string")
    rows = pages.select("page_id", "url", "html").union(odd)
    sums = []
    for n, parts in ((0, 3), (1, 7)):
        out = f"file://{tmp_path}/{n}"
        manifest = warc.write_archive(rows.repartition(parts), out, shard_bytes=60_000, roll_bytes=9_000)
        sums.append(sorted((r["name"], r["sha256"], r["records"]) for r in manifest.collect()))
        assert len(sums[-1]) > 3
        back = [tuple(r) for r in warc.read_archive(spark, out).collect()]
    assert sums[0] == sums[1]
    from hashlib import sha1

    texts = [(r[0], (r[2] or "").encode()) for r in rows.collect()]
    lead = {}
    for i, data in texts:
        if i is not None:
            lead[data] = min(lead.get(data, i), i)
    want = [(i, len(x), warc.base64.b32encode(sha1(x).digest()).decode(), *(("revisit", lead[x]) if i is not None and lead[x] < i else ("response", None))) for i, x in texts]
    assert sorted(back, key=str) == sorted(want, key=str)


def test_warc_of_an_empty_table(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.write_archive(none, f"file://{tmp_path}/e").count() == 0
    assert warc.read_archive(spark, f"file://{tmp_path}/e").count() == 0

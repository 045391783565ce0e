"""Conversation trie, tokenizer alignment and URL filters."""

import random
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ragbench.llm import conversation_trie as trie
from ragbench.llm import token_align, url_rules
from ragbench.operators import ordered

SF = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def many_ranges(spark):
    """Small tables in as many ranges as there are shuffle partitions."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.set(name, "true")


# --- running values over ranges


def test_running_values_match_plain_windows(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, 1, 2, 2, 2, 2, 3]), i, rng.randrange(9) if rng.random() < 0.6 else None) for i in range(500)]
    frame = ordered.in_ranges(spark.createDataFrame(rows, "g int, i int, v int").repartition(7), ["g", "i"], "t")
    assert frame.select("range_no").distinct().count() > 1
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    sums = {r["i"]: r["s"] for r in ordered.running_sums(frame, ["g", "i"], {"s": F.col("v")}, ["g"]).collect()}
    last = {r["i"]: r["s"] for r in ordered.last_values(frame, ["g", "i"], {"s": F.col("v")}).collect()}
    after = {r["i"]: r["next_i"] for r in ordered.next_values(frame, ["g", "i"], ["g"], ["i"]).collect()}
    seen, total, n = None, {}, {}
    for k, (g, i, v) in enumerate(rows):
        total[g], n[g] = total.get(g, 0) + (v or 0), n.get(g, 0) + (v is not None)
        seen = v if v is not None else seen
        assert sums[i] == (total[g] if n[g] else None) and last[i] == seen
        assert after[i] == (rows[k + 1][1] if k + 1 < len(rows) and rows[k + 1][0] == g else None)


# --- conversation trie


def plain_trie(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest(), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(t)] for c, t in own.items()}
    full = {}
    for c, t in own.items():
        h, base = zlib.crc32(str(c).encode()) % 9, int(c / 5) * 5
        full[c] = own.get(base, [])[:h] + t[h:]
    nodes = {}
    for c, t in full.items():
        for d in range(len(t) + 1):
            nodes.setdefault(tuple(t[:d]), []).append(c)
    out = {}
    for k, members in nodes.items():
        below = [x for x in nodes if x[: len(k)] == k]
        kids = lambda x: [y for y in nodes if len(y) == len(x) + 1 and y[: len(x)] == x]
        ends = ",".join(map(str, sorted(c for c in members if len(full[c]) == len(k))))
        out[min(members), len(k)] = (
            min(nodes[k[:-1]]) if k else None, len(members), len(kids(k)), sum(not kids(x) for x in below),
            sum((len(nodes[x]) - 1) * len(x[-1][1].encode()) for x in below if x), sha256(ends.encode()).hexdigest(),
        )
    return out


def trie_rows(df):
    return {(r["conv_id"], r["depth"]): tuple(r[c] for c in ("parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")) for r in df.collect()}


def odd_conversations():
    rng = random.Random(6)
    rows = []
    for c in [*range(-7, 30), 1000, 1003, 2**40]:
        if c in (10, 15):
            continue  # bases that are absent
        rows += [(c, k if k else None, rng.choice(["user", "assistant", None]), rng.choice(["a", "é b", "", None, "c"])) for k in range(rng.choice([0, 1, 2, 9, 12]))]
    rows += [(c, k, "user", "same") for c in (20, 40, 45) for k in range(10)] + [(50, 3, "user", "x" * 20_000)] * 2
    return rows + [(None, 1, "user", "of nobody")]


def test_trie_matches_a_plain_one(spark):
    rows = odd_conversations()
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("depth", F.lit("clash")).repartition(5)
    got = trie_rows(trie.prefix_trie(*trie.rebuilt(trie.turns_of(table)), least=120))
    assert got == plain_trie(rows)


def test_trie_of_the_given_table_and_of_none(spark):
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    assert trie_rows(trie.op11_prefix_trie(table)) == plain_trie([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])
    assert trie.op11_prefix_trie(table.limit(0)).count() == 0


def test_lists_are_ranked_with_weights(spark):
    n = 3_000
    names = [f"e{k}" for k in range(n)]
    random.Random(1).shuffle(names)
    rows = [(names[k], names[k + 1] if k + 1 < n else None, 1, k % 7) for k in range(n)]
    got = {r["id"]: (r["one"], r["w"]) for r in trie.list_rank(spark.createDataFrame(rows, "id string, next string, one long, w long"), ("one", "w"), 100).collect()}
    upto = np.concatenate(([0], np.cumsum([k % 7 for k in range(n)])))
    assert got == {names[k]: (k, upto[k]) for k in range(n)}


def test_end_digests_of_many_members(spark):
    ids = [*range(-700, 2000, 3), 2**50]
    rows = [("k", c) for c in ids] + [("l", 5)]
    got = dict(tuple(r) for r in trie.end_digests(spark.createDataFrame(rows, "key string, conv long").repartition(6)).collect())
    assert got == {"k": sha256(",".join(map(str, ids)).encode()).hexdigest(), "l": sha256(b"5").hexdigest()}


# --- tokenizer alignment


@pytest.fixture(scope="module")
def both():
    return token_align.Tokenizers(*(open(f"{token_align.FOLDER}/{f}", "rb").read() for f in (token_align.A_FILE, token_align.B_FILE)))


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(f"{token_align.FOLDER}/{token_align.A_FILE}")
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=f"{token_align.FOLDER}/{token_align.B_FILE}")


def whole(text, both, libraries):
    """(groups as text, links) of a whole text by the two libraries themselves, or None."""
    if not text:
        return None
    a, b = libraries[0].encode(" " + text, add_special_tokens=False).ids, libraries[1].encode(text)
    data = b" " + text.encode()
    if b"".join(both.a_bytes[i] for i in a) != data or b"".join(both.b_bytes[i] for i in b) != data:
        return None
    spans = []
    for ids, sizes in ((a, both.a_size), (b, both.b_size)):
        ends = np.cumsum(sizes[ids]).tolist()
        spans.append([(s, e, i) for s, e, i in zip([0, *ends[:-1]], ends, ids, strict=True)])
    cuts = sorted({x[1] for x in spans[0]} & {x[1] for x in spans[1]})
    groups = ";".join("|".join(",".join(str(i) for _, e, i in side if low < e <= high) for side in spans) for low, high in zip([0, *cuts[:-1]], cuts, strict=True))
    links, j = [], 0
    for s, e, i in spans[0]:
        while spans[1][j][1] <= s:
            j += 1
        k = j
        while k < len(spans[1]) and spans[1][k][0] < e:
            links.append((i, spans[1][k][2]))
            k += 1
    return len(a), len(b), groups, links


def figures(both, texts):
    block = token_align.Block(both, texts)
    sums = [block.sums(x).tolist() for x in (block.words.n_a, block.words.n_b, block.words.n_groups, block.words.n_links)]
    return [(*x, d) for *x, d in zip(*sums, block.digest, strict=True)]


ODD_TEXTS = [
    None, "", " ", "  lead", "trail  ", "a  b   c", "\n\n x \n", "<|endoftext|> x", "<s> </s> <unk>", "▁x", "x ▁y", "é ́x", "😀 😀  😀", "\u2003x\u00a0y\u3000z", "\x00 a\x00b", "tab\t\tx \t y",
    "it's don't 'LL x's 's", "a\r\n b\r\n", "\x1c a \x1d", "<0x41> <0x0A>", "ab" * 1500 + " " + "c" * 5000 + " d", " " * 50_000, "x" * 30_000 + " y", "\ufeffx",
]


def test_words_give_the_tokens_of_whole_texts(spark, both, libraries):
    texts = [*ODD_TEXTS, *(r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect())]
    for text, got in zip(texts, figures(both, texts), strict=True):
        want = whole(text, both, libraries)
        assert got == ((0, 0, 0, 0, "") if want is None else (want[0], want[1], want[2].count(";") + 1, len(want[3]), sha256(want[2].encode()).hexdigest()))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from([*"ab 's\n\t.1é▁<>|", " ", "\u2009", "\u0301", "字"]), max_size=40), min_size=1, max_size=4))
def test_any_texts_give_the_tokens_of_whole_texts(both, libraries, texts):
    for text, got in zip(texts, figures(both, texts), strict=True):
        want = whole(text, both, libraries)
        assert got == ((0, 0, 0, 0, "") if want is None else (want[0], want[1], want[2].count(";") + 1, len(want[3]), sha256(want[2].encode()).hexdigest()))


def test_ranks_split_every_token_as_the_files_merges_do(both):
    import json

    letters = token_align.byte_letters()
    raw = lambda t: bytes(letters[c] for c in t)
    rank = {t: i for i, t in enumerate(both.a_bytes) if t}
    for merge in json.load(open(f"{token_align.FOLDER}/{token_align.A_FILE}"))["model"]["merges"]:
        left, right = map(raw, merge.split(" ") if isinstance(merge, str) else merge)
        parts = [bytes([x]) for x in left + right]
        while len(parts) > 2:
            ranks = [rank.get(x + y, 1 << 30) for x, y in zip(parts, parts[1:])]
            at = int(np.argmin(ranks))
            assert ranks[at] < rank[left + right]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        assert parts == [left, right]


@pytest.mark.parametrize("block", [20_000, token_align.BLOCK_BYTES])
def test_alignment_counts_over_the_corpus(spark, both, libraries, block):
    given = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in given.collect()] + [(9000 + i, t) for i, t in enumerate(ODD_TEXTS[:16])] + [(9001, "twice the same"), (9001, "twice the same"), (None, "without an id")]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"block": F.lit("mine"), "no": F.col("doc_id"), "N_A": F.lit("gone")}).repartition(5)
    links = [(whole(t, both, libraries) or (0, 0, "", []))[3] for _, t in rows]
    count = Counter(p for x in links for p in set(x))
    most = {}
    for (a, _), n in count.items():
        most[a] = max(most.get(a, 0), n)
    want = Counter((i, len(x), sum(count[p] == most[p[0]] for p in x), sum(count[p] for p in x)) for (i, _), x in zip(rows, links, strict=True))
    out = token_align.align(table, block_bytes=block)
    assert out.columns == ["doc_id", "block", "no", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    got = out.collect()
    assert Counter((r["doc_id"], r["n_links"], r["n_best"], r["count_sum"]) for r in got) == want
    assert all(r["block"] == "mine" and r["no"] == r["doc_id"] for r in got)
    assert token_align.align(table.limit(0)).count() == 0


def test_groups_of_tokens(spark, both, libraries):
    rows = [(1, "some words of text"), (2, None), (3, "")]
    got = {r["doc_id"]: r["groups"] for r in token_align.token_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[2] == got[3] == []
    assert ";".join(",".join(map(str, g["a"])) + "|" + ",".join(map(str, g["b"])) for g in got[1]) == whole(rows[0][1], both, libraries)[2]


# --- URL filters


def url_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = rest[: min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))]
    path = rest[len(host) :]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def test_url_rules_match_trying_all(spark):
    rng = random.Random(1)
    host = lambda: ".".join(rng.choice(["a", "b", "net", "a-b", "", "x!", "é", "a.b"]) for _ in range(rng.randrange(1, 5)))
    paths = ["", "/", "/a", "/a/", "/ab", "/a/b/", "/é", "/a/b/c"]
    rules = [(*k, v) for k, v in {(host(), rng.choice(paths)): rng.choice(["allow", "block"]) for _ in range(60)}.items()]
    urls = [(i, f"http://{host()}{rng.choice(paths)}{rng.choice(['', '?x', '#y/'])}") for i in range(1500)]
    urls += [(9000, None), (9001, ""), (9002, "no scheme"), (9003, "HTTP://A.NET"), (9004, "x://y://a.net/a"), (9005, "http://a.b\n/a\n"), (9006, "http://a/" + "z" * 50_000), (1, urls[1][1]), (None, "http://a.b/a")]
    table = spark.createDataFrame(urls, "page_id long, url string").withColumns({c: F.lit(c) for c in ("key", "level", "h", "of_host", "verdict")}).repartition(5)
    got = url_rules.judge_urls(table, url_rules.rule_table(spark, [*rules, (None, "/", "block"), ("c", "/", None)]))
    assert got.columns == ["page_id", "url", "key", "level", "h", "of_host", "host", "path", "rule", "verdict"]

    def plain(url):
        h, p = url_parts(url)
        fits = [(len(a) + len(b), len(a), a + b, v) for a, b, v in rules if (h == a or h.endswith("." + a)) and p.startswith(b)]
        best = max(fits, key=lambda r: r[:2], default=(0, 0, None, "allow"))
        return h, p, best[2], best[3]

    want = Counter((i, u, *plain(u)) for i, u in urls)
    assert Counter((r["page_id"], r["url"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got.collect()) == want
    assert url_rules.judge_urls(table, url_rules.rule_table(spark, rules)).drop("host").where("key != 'key' or h != 'h'").count() == 0
    assert {r[0] for r in url_rules.judge_urls(table, url_rules.rule_table(spark, rules).limit(0)).select("verdict").collect()} == {"allow"}
    assert url_rules.judge_urls(table.limit(0), url_rules.rule_table(spark, rules)).count() == 0


def test_new_queries_match_their_sql(spark):
    import duckdb

    from ragbench.llm import queries

    con = duckdb.connect()
    for name in ("conversations", "pages"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    for name in ("op11_prefix_trie", "op13_url_filter"):
        found = queries.queries()[name](spark, SF)
        want = con.execute(queries.oracle_sql()[name])
        assert [x[0] for x in want.description] == found.columns
        key = lambda r: tuple((x is not None, x) for x in r)
        assert sorted(map(tuple, found.collect()), key=key) == sorted(want.fetchall(), key=key)

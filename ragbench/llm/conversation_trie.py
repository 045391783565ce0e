"""Trie of conversations' common beginnings, with subtree figures by the Euler-tour technique.

A node is a sequence of turns with which conversations begin. Its key is its depth and two running sums of 64-bit hashes of
(turn, position), so keys come from prefix sums over any number of turns. Every node gives an enter and an exit arc; an arc's
successor is known from the node, its first child, its next sibling and its parent alone. The tour is one linked list, ranked
without walking it: in each round every arc whose coin (a hash) shows 0 takes in its successor if that one's coin shows 1, which
shortens the list by a quarter; what is left after all rounds (``LEAST`` arcs) is ranked in one task, and the rounds are
undone. Ranking with weights gives, at every arc, its position and the sums of leaves and savings before it; a subtree is what
lies between a node's two arcs.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragbench.llm.common import stored
from ragbench.operators.ordered import in_ranges, next_values, running_sums

#: The list is contracted until so many elements are left.
LEAST = 8_192
#: Ids in one piece of a node's list of members: 2 to this power.
PIECE_BITS = 8
ROOT = "0:0:0"
WEIGHTS = ("position", "leaves", "saved")


def turns_of(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, rank, item, size): each conversation's turns from 1, with a hash of role and text and the text's UTF-8 bytes.

    Null turns come first; turns of one number are ordered by the hash. Null role or text counts as empty. Rows without a conv_id
    belong to no conversation and are left out. A conversation may have any number of turns: ranks are running counts.
    """
    who, what = (F.coalesce(F.col(c), F.lit("")) for c in (role, text))
    item = F.sha2(F.concat(F.octet_length(who).cast("string"), F.lit(":"), who, what).cast("binary"), 256)
    rows = conversations.where(F.col(conv_id).isNotNull()).select(F.col(conv_id).alias("conv"), F.col(turn).alias("turn"), item.alias("item"), F.octet_length(what).cast("long").alias("size"))
    order = ["conv", "turn", "item"]
    return running_sums(in_ranges(rows, order, "turns"), order, {"rank": F.lit(1)}, ["conv"]).select("conv", "rank", "item", "size")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The contract's conversations from ``turns_of``: (conv, depth, item, size, last) and (conv, length).

    Conversation c begins with the first h turns of conversation c - c%5 and goes on with its own turns after its first h;
    h = crc32(decimal c) % 9.
    """
    turns = stored(turns, "turns-ranked")
    own = turns.groupBy("conv").agg(F.max("rank").alias("n"))
    own = stored(own.withColumn("base", F.col("conv") - F.col("conv") % 5).withColumn("h", F.crc32(F.col("conv").cast("string").cast("binary")) % 9), "convs")
    bases = own.select(F.col("conv").alias("of"), F.col("n").alias("n_of"))
    convs = own.join(bases.hint("shuffle_merge"), F.col("base") == F.col("of"), "left").withColumn("taken", F.least("h", F.coalesce("n_of", F.lit(0))))
    convs = stored(convs.select("conv", "h", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "convs-rebuilt")
    to = convs.withColumnRenamed("conv", "to")
    # Five conversations (nine around 0) begin with turns of this one.
    steps = F.when(F.col("conv") > 0, F.sequence(F.lit(0), F.lit(4))).when(F.col("conv") < 0, F.sequence(F.lit(-4), F.lit(0))).otherwise(F.sequence(F.lit(-4), F.lit(4)))
    heads = turns.where("conv % 5 = 0 AND rank <= 8").select("conv", F.explode(steps).alias("step"), "rank", "item", "size").withColumn("to_conv", F.col("conv") + F.col("step"))
    heads = heads.join(to.hint("shuffle_merge"), (F.col("to_conv") == F.col("to")) & (F.col("rank") <= F.col("h"))).select(F.col("to").alias("conv"), F.col("rank").alias("depth"), "item", "size", "length")
    tails = turns.join(to.hint("shuffle_merge"), F.col("conv") == F.col("to")).where("rank > h").select("conv", (F.col("rank") - F.col("h") + F.col("taken")).alias("depth"), "item", "size", "length")
    rows = heads.unionByName(tails)
    return rows.select("conv", "depth", "item", "size", (F.col("depth") == F.col("length")).alias("last")), convs.select("conv", "length")


def list_rank(links: DataFrame, values: tuple[str, ...], least: int = LEAST) -> DataFrame:
    """(id, values): for each element of one linked list (id, next, values) the sums of the values before it.

    ``next`` is null at the end. Every round is one join of some three quarters of the list, written; the rounds undone cost as
    much again, so the whole moves a fixed multiple of the list at any length.
    """
    columns = ["id", "next", *values]
    made = [f"before_{v}" for v in values]
    table, gone, k = stored(links.select(*columns), "list"), [], 0
    while table.count() > least:
        coin = lambda c, k=k: F.pmod(F.xxhash64(c, F.lit(k)), F.lit(2))
        takes = (coin("id") == 0) & F.col("next").isNotNull() & (coin("next") == 1)
        takers = table.where(takes).select(F.col("id").alias("into"), F.col("next").alias("taken"), *(F.col(v).alias(f"before_{v}") for v in values))
        met = table.where(coin("id") == 1).join(takers.hint("shuffle_merge"), F.col("id") == F.col("taken"), "left").drop("taken")
        none = [F.lit(None).cast(takers.schema[c].dataType).alias(c) for c in ("into", *made)]
        others = table.where((coin("id") == 0) & ~takes).select(*columns, *none)
        alive = F.struct(F.coalesce("into", "id").alias("id"), "next", *((F.col(v) + F.coalesce(f"before_{v}", F.lit(0))).alias(v) for v in values), *none)
        lost = F.struct("id", "next", *values, "into", *made)
        both = met.select(F.explode(F.when(F.col("into").isNull(), F.array(alive)).otherwise(F.array(alive, lost))).alias("x")).select("x.*")
        written = stored(others.unionByName(both), f"list-{k}")
        gone.append(written.where("into is not null").select("id", "into", *made))
        table, k = written.where("into is null").select(*columns), k + 1

    def rank(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = list(frames)
        if not frames:
            return
        ids, then = (np.concatenate([f[c].to_numpy(dtype=object) for f in frames]) for c in ("id", "next"))
        ends = pd.isna(then)
        at = np.where(ends, -1, pd.Index(ids, dtype=object).get_indexer(np.where(ends, "", then)))
        sums = np.concatenate([f[list(values)].to_numpy(dtype=np.int64) for f in frames])  # of each element and, in the end, of all behind it
        total = sums.sum(axis=0)
        while (on := np.flatnonzero(at >= 0)).size:
            sums[on], at[on] = sums[on] + sums[at[on]], at[at[on]]
        yield pd.DataFrame({"id": ids, **{v: total[j] - sums[:, j] for j, v in enumerate(values)}})

    ranks = [stored(table.coalesce(1).mapInPandas(rank, ", ".join(["id string", *(f"{v} long" for v in values)])), "ranks")]
    for lost in reversed(gone):
        known = ranks[0]
        for r in ranks[1:]:
            known = known.unionByName(r)
        known = known.withColumnRenamed("id", "known")
        ranks.append(stored(lost.join(known.hint("shuffle_merge"), F.col("into") == F.col("known")).select("id", *((F.col(v) + F.col(f"before_{v}")).alias(v) for v in values)), "ranks"))
    out = ranks[0]
    for r in ranks[1:]:
        out = out.unionByName(r)
    return out


def _arc(conv: Column, depth: Column, side: int) -> Column:
    return F.concat_ws(":", conv.cast("string"), depth.cast("string"), F.lit(str(side)))


def end_digests(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256): SHA-256 of the ascending ids (conv) of each key, comma-joined.

    Ids are joined in pieces of neighbouring numbers, and one pass over a key's sorted pieces feeds the digest, so a key with any number
    of ids takes the memory of one batch.
    """
    pieces = ends.groupBy("key", F.shiftright("conv", PIECE_BITS).alias("piece")).agg(F.array_join(F.array_sort(F.collect_list("conv")).cast("array<string>"), ",").alias("ids"))

    def digest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, sha256()
        for frame in frames:
            done = []
            for k, ids in zip(frame["key"], frame["ids"], strict=True):
                if k != key:
                    if key is not None:
                        done.append((key, state.hexdigest()))
                    key, state = k, sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pd.DataFrame(done, columns=["key", "ends_sha256"])
        if key is not None:
            yield pd.DataFrame([(key, state.hexdigest())], columns=["key", "ends_sha256"])

    return pieces.repartition("key").sortWithinPartitions("key", "piece").select("key", "ids").mapInPandas(digest, "key string, ends_sha256 string")


def prefix_trie(rows: DataFrame, convs: DataFrame, least: int = LEAST) -> DataFrame:
    """One row for each node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``rows`` has (conv long, depth from 1 without gaps, item, size, last), ``convs`` (conv, length) every conversation, also those without turns. The root
    has depth 0 and no parent; without conversations there is no node. saved_tokens sums (members - 1) x size over the subtree.
    A node with any number of children or members is split like other rows.
    """
    item = lambda seed: F.xxhash64("item", "depth", F.lit(seed)).cast("decimal(20,0)")
    order = ["conv", "depth"]
    rows = in_ranges(rows.withColumns({"s1": item(1), "s2": item(2)}), order, "rebuilt")
    rows = running_sums(rows, order, {"p1": F.col("s1"), "p2": F.col("s2")}, ["conv"])
    up = F.when(F.col("depth") == 1, F.lit(ROOT)).otherwise(F.concat_ws(":", F.col("depth") - 1, F.col("p1") - F.col("s1"), F.col("p2") - F.col("s2")))
    rows = stored(rows.select("conv", "depth", "size", "last", F.concat_ws(":", "depth", "p1", "p2").alias("key"), up.alias("up")), "members")
    nodes = rows.groupBy("key", "depth", "up").agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs"), F.min("size").alias("size"))
    root = convs.agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0").select(F.lit(ROOT).alias("key"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("string").alias("up"), "conv", "n_convs", F.lit(0).cast("long").alias("size"))
    nodes = stored(nodes.withColumn("depth", F.col("depth").cast("long")).unionByName(root), "nodes")
    kids = nodes.where("up is not null").groupBy(F.col("up").alias("of")).agg(F.count(F.lit(1)).alias("n_children"), F.min("conv").alias("first_child"))
    nodes = stored(nodes.join(kids.hint("shuffle_merge"), F.col("key") == F.col("of"), "left").drop("of").fillna({"n_children": 0}), "nodes-kids")
    parents = nodes.select(F.col("key").alias("of"), F.col("conv").alias("parent_conv"))
    nodes = nodes.join(parents.hint("shuffle_merge"), F.col("up") == F.col("of"), "left").drop("of", "up")
    order = ["depth", "parent_conv", "conv"]
    nodes = stored(next_values(in_ranges(nodes, order, "siblings"), order, ["depth", "parent_conv"], ["conv"]).drop("range_no"), "nodes-siblings")

    conv, depth = F.col("conv"), F.col("depth")
    enter = F.struct(
        _arc(conv, depth, 0).alias("id"), F.when(F.col("n_children") > 0, _arc(F.col("first_child"), depth + 1, 0)).otherwise(_arc(conv, depth, 1)).alias("next"),
        F.lit(1).cast("long").alias("position"), (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("size")).alias("saved"),
    )
    leave = F.struct(
        _arc(conv, depth, 1).alias("id"), F.when(F.col("next_conv").isNotNull(), _arc(F.col("next_conv"), depth, 0)).when(depth > 0, _arc(F.col("parent_conv"), depth - 1, 1)).alias("next"),
        F.lit(1).cast("long").alias("position"), F.lit(0).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"),
    )
    ranks = list_rank(nodes.select(F.explode(F.array(enter, leave)).alias("x")).select("x.*"), WEIGHTS, least)
    entered = F.col("id").endswith(":0")
    between = lambda v: F.sum(F.when(entered, -F.col(v)).otherwise(F.col(v)))
    spans = ranks.groupBy(F.substring_index("id", ":", 2).alias("node")).agg(between("leaves").alias("n_leaves"), between("saved").alias("saved_tokens"), F.min("position").alias("entered_at"))
    ends = rows.where("last").select("key", "conv").unionByName(convs.where("length = 0").select(F.lit(ROOT).alias("key"), "conv"))
    digests = end_digests(ends).withColumnRenamed("key", "of")
    out = nodes.join(spans.hint("shuffle_merge"), F.concat_ws(":", "conv", "depth") == F.col("node")).join(digests.hint("shuffle_merge"), F.col("key") == F.col("of"), "left")
    return out.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(sha256(b"").hexdigest())).alias("ends_sha256"), "entered_at",
    )


def op11_prefix_trie(conversations: DataFrame) -> DataFrame:
    """Contract of the query: the trie of the rebuilt conversations."""
    rows, convs = rebuilt(turns_of(conversations))
    return prefix_trie(rows, convs).drop("entered_at")


#: DuckDB: keys are digests of all turns so far, subtrees come from joining every node with the nodes that its smallest member passes.
ORACLE = """
WITH t AS (SELECT conv_id AS c, item, size, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, item) AS r FROM (
    SELECT conv_id, turn, sha256(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS item, strlen(coalesce(text, '')) AS size
    FROM conversations WHERE conv_id IS NOT NULL)),
own AS (SELECT c, count(*) AS n, c - c % 5 AS b, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))), 4294967295) % 9 AS h FROM t GROUP BY c),
v AS (SELECT own.c, own.n, own.b, own.h, least(own.h, coalesce(o.n, 0)) AS k FROM own LEFT JOIN own AS o ON o.c = own.b),
w AS (SELECT v.c, t.r AS d, item, size FROM v JOIN t ON t.c = v.b AND t.r <= v.h UNION ALL SELECT v.c, t.r - h + k, item, size FROM v JOIN t ON t.c = v.c AND t.r > h),
m AS (SELECT c, d, size, sha256(string_agg(item, '') OVER (PARTITION BY c ORDER BY d)) AS key, d = max(d) OVER (PARTITION BY c) AS ends FROM w
    UNION ALL SELECT v.c, 0, 0, '', k + greatest(n - h, 0) = 0 FROM v),
g AS (SELECT key, d, min(c) AS c, count(*) AS n_convs, any_value(size) AS size, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256 FROM m GROUP BY key, d),
p AS (SELECT g.*, u.c AS parent, u.key AS up FROM g LEFT JOIN m ON m.c = g.c AND m.d = g.d - 1 LEFT JOIN g AS u ON u.key = m.key AND u.d = m.d),
kids AS (SELECT up, d - 1 AS d, count(*) AS n FROM p WHERE up IS NOT NULL GROUP BY ALL),
f AS (SELECT p.*, coalesce(kids.n, 0) AS n_children FROM p LEFT JOIN kids ON kids.up = p.key AND kids.d = p.d),
s AS (SELECT m.key, m.d, count(*) FILTER (f.n_children = 0) AS n_leaves, sum((f.n_convs - 1) * f.size)::BIGINT AS saved FROM f JOIN m ON m.c = f.c AND m.d <= f.d GROUP BY ALL)
SELECT f.c AS conv_id, f.d::BIGINT AS depth, f.parent AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved AS saved_tokens, f.ends_sha256
FROM f JOIN s ON s.key = f.key AND s.d = f.d"""

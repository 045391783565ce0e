"""Mixing sources to target weights by Pfair scheduling.

A source's stream is its documents in the order of a hash of their ids, cut into blocks of ``block_bytes``. With w[s]
the exact share of source s (whole numbers over their sum, nothing rounded), block j of s is released at slot
floor(j/w[s]) and due by slot ceil((j+1)/w[s]); the released block with the earliest deadline takes the next slot. At
any slot, however late, each source that has not ended is then less than one block away from its target.

The driver deals the slots, one step for each block, and writes them out in pieces, so that it holds one piece and one
entry for each source. The documents themselves never meet in one place: offsets within a source come from sums over
hash ranges, and each range reads the slots of its own blocks.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ragbench.llm.common import Columns, new_path, stored

#: The least size of a block, and the blocks of a table from which they grow: the driver takes one step for each.
BLOCK_BYTES, MOST_BLOCKS = 16_384, 4_000_000
#: Hash ranges in each source's stream (four hexadecimal digits), of which a task handles some, and those summed together.
RANGES, GROUP = 65_536, 256
#: Slots in a row of the slot table, and slots that the driver holds at once.
PIECE, HELD = 1024, 500_000


def weights(sizes: dict, target: dict | None, power: float) -> dict:
    """Whole numbers in the exact proportion of the ``target`` (read as decimals), or of the sizes to the power."""
    if target is not None and (lost := [s for s, n in sizes.items() if n > 0 and s not in target]):
        raise ValueError(f"no target weight for the sources {lost[:10]}")
    exact = {s: Fraction(str(target[s] if target is not None else float(n) ** power)) for s, n in sizes.items() if n > 0}
    if exact and min(exact.values()) <= 0:
        raise ValueError("every source needs a positive weight")
    whole = math.lcm(*(x.denominator for x in exact.values()))
    numbers = {s: int(x * whole) for s, x in exact.items()}
    common = math.gcd(*numbers.values())
    return {s: n // common for s, n in numbers.items()}


def slots_of(shares: dict, blocks: dict) -> Iterator[tuple]:
    """(source, block, slot) in the order of slots: earliest deadline first among the released blocks.

    A source ends after its ``blocks``; a slot for which nothing is released stays empty.
    """
    total = sum(shares.values())
    release = [(0, -(-total // p), str(s), s, 0) for s, p in shares.items()]
    heapq.heapify(release)
    ready: list = []
    t = 0
    while release or ready:
        if not ready:
            t = max(t, release[0][0])
        while release and release[0][0] <= t:
            r, d, name, s, j = heapq.heappop(release)
            # Ties: the block whose deadline overlaps the next release, then the heavier source, then the name.
            heapq.heappush(ready, (d, -((j + 1) * total % shares[s] != 0), -shares[s], name, s, j))
        d, _, _, name, s, j = heapq.heappop(ready)
        yield s, j, t
        t += 1
        if j + 1 < blocks[s]:
            heapq.heappush(release, ((j + 1) * total // shares[s], -(-(j + 2) * total // shares[s]), name, s, j + 1))


def slot_table(spark: SparkSession, shares: dict, blocks: dict, source_type: str) -> DataFrame:
    """(_t, _b, _slot): the slot of every block of every source, written by the driver in pieces."""
    path, schema = new_path(spark, "slots"), f"_t {source_type}, _first long, _slots array<long>"
    rows: list = []
    lists: dict = {}
    held = 0

    def write() -> None:
        spark.createDataFrame(rows + [(s, *x) for s, x in lists.items()], schema, verifySchema=False).write.mode("append").parquet(path)

    for s, j, t in slots_of(shares, blocks):
        if s not in lists:
            lists[s] = (j, [])
        lists[s][1].append(t)
        held += 1
        if len(lists[s][1]) == PIECE:
            rows.append((s, *lists.pop(s)))
        if held == HELD:
            write()
            rows, lists, held = [], {}, 0
    write()
    pieces = spark.read.schema(schema).parquet(path)
    return pieces.select("_t", "_first", F.posexplode("_slots").alias("_i", "_slot")).select("_t", (F.col("_first") + F.col("_i")).alias("_b"), "_slot")


def _order_key(doc_id: Column, text: Column) -> Column:
    """A hash of the id and the text, so that rows without an id, or with equal ids, spread over the ranges too."""
    return F.md5(F.concat_ws(":", doc_id.cast("string"), F.xxhash64(text).cast("string")).cast("binary"))


def mix(docs: DataFrame, target: dict | None = None, power: float = 0.7, text: str = "text", source: str = "source", doc_id: str = "doc_id", block_bytes: int | None = None) -> DataFrame:
    """All rows and columns, with ``block`` (of the source), ``slot`` (of the mix) and ``place`` (in the source's stream).

    Ordered by (slot, place, doc_id), the rows are the mix. Without ``target`` a source's weight is its size in bytes
    to the power ``power``; a source that the target lacks, or a weight that is not positive, is an error. Without
    ``block_bytes`` a block has BLOCK_BYTES, or the least power of two that leaves at most MOST_BLOCKS blocks.

    Nothing is dropped: when a source has ended, its later slots stay empty and the others go on in proportion; the
    bound of one block holds up to there. A null source is a source of its own; null and empty texts take one byte,
    so that they have a place; a document longer than a block belongs to the block where it starts, and the slots of
    the blocks that it fills stay empty, so counted in bytes the bound is one block and the longest document. Repeated
    rows are separate documents, next to each other. Columns named like outputs are replaced, all others stay,
    whatever their names; an empty table gives an empty table.
    """
    table = Columns(docs)
    text, source, doc_id = table.name(text), table.name(source), table.name(doc_id)
    size = F.greatest(F.coalesce(F.octet_length(text), F.lit(0)), F.lit(1)).cast("long")
    rows = table.rows.withColumn("size", size).withColumn("md5", _order_key(F.col(doc_id), F.col(text))).withColumn("range", F.conv(F.substring("md5", 1, 4), 16, 10).cast("int"))
    sums = stored(rows.groupBy(F.col(source).alias("s"), F.col("range").alias("r")).agg(F.sum("size").alias("sum")), "ranges")
    found = {r[0]: r[1] for r in sums.groupBy("s").agg(F.sum("sum").alias("n")).collect()}
    if block_bytes is None:
        block_bytes = BLOCK_BYTES
        while sum(found.values()) > block_bytes * MOST_BLOCKS:
            block_bytes *= 2
    source_type = table.rows.schema[source].dataType.simpleString()
    slots = slot_table(docs.sparkSession, weights(found, target, power), {s: -(-n // block_bytes) for s, n in found.items()}, source_type)
    # At most RANGES rows for each source, each with the slots of the blocks that its bytes lie in. Offsets come from
    # sums over GROUP ranges and from sums within each, so that no source's ranges meet in one task.
    sums = sums.withColumn("g", F.floor(F.col("r") / GROUP))
    groups = sums.groupBy(F.col("s").alias("gs"), F.col("g").alias("gg")).agg(F.sum("sum").alias("gsum"))
    groups = groups.withColumn("start", F.sum("gsum").over(Window.partitionBy("gs").orderBy("gg")) - F.col("gsum"))
    inner = sums.withColumn("upto", F.sum("sum").over(Window.partitionBy("s", "g").orderBy("r")) - F.col("sum"))
    offsets = inner.join(groups.hint("shuffle_merge"), inner["s"].eqNullSafe(groups["gs"]) & (inner["g"] == groups["gg"])).withColumn("offset", F.col("start") + F.col("upto"))
    first, last = F.floor(F.col("offset") / block_bytes).cast("long"), F.floor((F.col("offset") + F.col("sum") - 1) / block_bytes).cast("long")
    touched = offsets.select("s", "r", "offset", first.alias("first"), F.explode(F.sequence(first, last)).alias("b"))
    dealt = touched.join(slots.hint("shuffle_merge"), touched["s"].eqNullSafe(slots["_t"]) & (touched["b"] == slots["_b"]))
    starts = stored(dealt.groupBy("s", "r", "offset", "first").agg(F.sort_array(F.collect_list("_slot")).alias("slots")), "starts")
    inside = Window.partitionBy(source, "range").orderBy("md5", doc_id)
    placed = rows.withColumn("before", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    joined = placed.join(starts.hint("shuffle_merge"), placed[source].eqNullSafe(starts["s"]) & (placed["range"] == starts["r"]))
    place = F.col("offset") + F.col("before")
    block = F.floor(place / block_bytes).cast("long")
    slot = F.element_at("slots", (block - F.col("first") + 1).cast("int"))
    return table.done(joined, {"block": block, "slot": slot, "place": place})


def op7_mixing(docs: DataFrame) -> DataFrame:
    """The query: the place of every document in the mix."""
    return mix(docs.select("doc_id", "source", "text")).select("doc_id", "source", "block", "slot", "place")

"""Benchmark decontamination with one Aho-Corasick automaton over the normalised test texts.

Words are lower-cased (A-Z) runs of ASCII letters, digits and non-ASCII characters. Each distinct word of the
benchmark becomes one symbol, each window of test words a short string of symbols, and the automaton holds all
these strings: a document is turned into symbols and scanned once. Matches are word ranges, which map back to
character offsets of the original text.

Memory: an automaton holds about ``block_words`` window words (some 100 bytes each), and a worker one automaton. A
benchmark with more is cut into blocks by a hash of the item; the driver reads one block at a time, each block has a
pass of its own over the documents, of which only the texts with matches are kept (by a hash of the text, in the
shared folder), and the matches of all blocks are joined back. Nothing is left out at any size of the benchmark.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragbench.llm.common import Columns, stored

WINDOW = 13
#: Window words in one automaton, about (an item is never split).
BLOCK_WORDS = 1_000_000
_KEEP = frozenset(b"abcdefghijklmnopqrstuvwxyz0123456789") | frozenset(range(0x80, 0x100))
_NORMAL = bytes(x if (x := c + 32 if 0x41 <= c <= 0x5A else c) in _KEEP else 0x20 for c in range(0x100))
_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Symbols are numbered from here, beyond the surrogates; as many fit into one character.
_FIRST, _SYMBOLS = 0x10000, 0x100000
_SPAN = "array<struct<start:int,end:int>>"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_NORMAL).split()


def windows_in(words: int, size: int = WINDOW) -> int:
    """Windows of an item: at every word that has enough after it; an item with fewer words is one window."""
    return max(1, words - size + 1) if words else 0


class Matcher:
    """The automaton of some test items, given as (id, text)."""

    def __init__(self, items: list[tuple], size: int = WINDOW):
        import ahocorasick

        self.ids = [i for i, _ in items]
        split = [(no, words_of(text)) for no, (_, text) in enumerate(items)]
        numbers: dict[bytes, int] = {}
        for _, words in split:
            for w in words:
                numbers.setdefault(w, len(numbers))
        # A symbol is one character, or two where there are more words than characters.
        self.width = 1 if len(numbers) < _SYMBOLS else 2
        self.none = chr(1) * self.width
        self.symbols = {w: self._symbol(n) for w, n in numbers.items()}
        self.automaton, self.holders = ahocorasick.Automaton(), []
        for item, words in split:
            line = "".join(map(self.symbols.__getitem__, words))
            for at in range(windows_in(len(words), size)):
                window = line[at * self.width : (at + size) * self.width]
                known = self.automaton.get(window, None)
                if known is None:
                    self.automaton.add_word(window, (len(window) // self.width, len(self.holders)))
                    self.holders.append([item])
                elif self.holders[known[1]][-1] != item:
                    self.holders[known[1]].append(item)
        if self.holders:
            self.automaton.make_automaton()

    def _symbol(self, n: int) -> str:
        return chr(_FIRST + n) if self.width == 1 else chr(_FIRST + n // _SYMBOLS) + chr(_FIRST + n % _SYMBOLS)

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], list]:
        """Word ranges that windows cover (end exclusive, merged, in order), and the ids of items with occurring windows."""
        runs: list[tuple[int, int]] = []
        items: set[int] = set()
        if not self.holders:
            return [], []
        get, none, width = self.symbols.get, self.none, self.width
        for end, (size, holder) in self.automaton.iter("".join([get(w, none) for w in words])):
            if (end + 1) % width:
                continue  # between two symbols
            last = (end + 1) // width
            items.update(self.holders[holder])
            runs.append((last - size, last))
        return merged(runs), sorted({self.ids[i] for i in items if self.ids[i] is not None})


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(runs):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


_MATCHERS: dict[str, Matcher] = {}


def char_spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character offsets, in the original text, of runs of words."""
    if not runs:
        return []
    at = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    return [(at[a][0], at[b - 1][1]) for a, b in runs]


def _scanner(matcher_of, id_type: str, runs_only: bool):
    """A function of texts: words, hit words, items and spans; or the words' runs and items alone."""
    schema = f"runs {_SPAN}, items array<{id_type}>" if runs_only else f"n_words long, n_hit long, items array<{id_type}>, spans {_SPAN}"
    names = [f.split()[0] for f in schema.split(", ")]

    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        matcher = matcher_of()
        for texts in batches:
            rows = []
            for t in texts:
                words = words_of(t)
                runs, items = matcher.match(words)
                rows.append((runs, items) if runs_only else (len(words), sum(b - a for a, b in runs), items, char_spans(t or "", runs)))
            yield pd.DataFrame(rows, columns=names)

    return F.pandas_udf(scan, schema)


def _joined_up(texts: pd.Series, runs: pd.Series) -> pd.DataFrame:
    rows = []
    for t, found in zip(texts, runs):
        spans = merged([(r["start"], r["end"]) for r in found]) if found is not None else []
        rows.append((len(words_of(t)), sum(b - a for a, b in spans), char_spans(t or "", spans)))
    return pd.DataFrame(rows, columns=["n_words", "n_hit", "spans"])


def _matcher(spark, items: list[tuple], size: int):
    """A function that gives the automaton; a worker builds it once and keeps it until it is asked for another."""
    key, shared = uuid.uuid4().hex, spark.sparkContext.broadcast(items)

    def of() -> Matcher:
        if key not in _MATCHERS:
            _MATCHERS.clear()
            _MATCHERS[key] = Matcher(shared.value, size)
        return _MATCHERS[key]

    return of


def contaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = WINDOW, block_words: int = BLOCK_WORDS, percent: int = 5) -> DataFrame:
    """Add ``n_words``, ``n_hit``, ``items`` (ids), ``spans`` and ``contaminated`` to every document; all columns stay.

    A document is contaminated if at least ``percent`` of its words, and one at least, are hit. Null and empty
    texts have no words and are clean; texts are scanned whole, whatever their length, and repeated rows alike. Ids may
    be of any type that can be ordered. Items without words match nothing; an id that several items have is listed
    once; items with a null id hit words but are not listed. Windows that several items share count for all of them.
    Input columns named like outputs are replaced, all others stay, whatever their names; an empty table gives an
    empty table, and an empty benchmark leaves every document clean.
    """
    spark = docs.sparkSession
    table = Columns(docs)
    text = table.name(text)
    items = benchmark.select(F.col(item_id).alias("item"), F.col(item_text).alias("item_text"))
    words = F.size(F.filter(F.split(F.coalesce("item_text", F.lit("")), _SEPARATORS, -1), lambda w: w != ""))
    load = items.agg(F.sum(F.when(words > 0, F.greatest(words - size + 1, F.lit(1)) * size))).first()[0] or 0
    blocks = max(1, -(-load // block_words))
    block = F.pmod(F.xxhash64("item", "item_text"), F.lit(blocks))
    id_type = benchmark.schema[item_id].dataType.simpleString()

    def scanner(k: int, runs_only: bool) -> Column:
        chosen = [tuple(r) for r in items.where(block == k).select("item", "item_text").orderBy("item", "item_text").collect()]
        return _scanner(_matcher(spark, chosen, size), id_type, runs_only)(F.col(text))

    if blocks == 1:
        rows, found_items = table.rows.withColumn("m", scanner(0, False)), F.col("m.items")
    else:
        hash_of = (F.xxhash64(text).alias("h"), F.xxhash64(F.lit(1), text).alias("h2"))
        parts = []
        for k in range(blocks):
            scanned = table.rows.where(F.col(text).isNotNull()).select(*hash_of, scanner(k, True).alias("m"))
            parts.append(stored(scanned.where(F.size("m.runs") > 0).dropDuplicates(["h", "h2"]).select("h", "h2", "m.runs", "m.items"), "hits"))
        hits = reduce(DataFrame.unionByName, parts).groupBy("h", "h2").agg(F.flatten(F.collect_list("runs")).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        rows = table.rows.select("*", *hash_of).join(hits.hint("merge"), ["h", "h2"], "left")
        ends = F.pandas_udf(_joined_up, f"n_words long, n_hit long, spans {_SPAN}")(F.col(text), F.col("runs"))
        rows, found_items = rows.withColumn("m", ends), F.coalesce("items", F.array().cast(f"array<{id_type}>"))
    hit = (F.col("m.n_hit") > 0) & (100 * F.col("m.n_hit") >= percent * F.col("m.n_words"))
    return table.done(rows, {"n_words": "m.n_words", "n_hit": "m.n_hit", "items": found_items, "spans": "m.spans", "contaminated": hit})


def op10_decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Contract of the query: counts and the digest of the items by document."""
    found = contaminate(docs.select("doc_id", "text"), benchmark)
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), "contaminated"
    )


#: DuckDB SQL for the query.
ORACLE = r"""
WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
bw AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bx AS (SELECT DISTINCT item_id, least(len(w), 13) AS k, w[i:i + least(len(w), 13) - 1] AS win FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM bw WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bx),
firsts AS (SELECT DISTINCT k, win[1] AS w1 FROM bx),
px AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM dw),
dx AS (SELECT px.doc_id, f.k, px.i, px.w[px.i:px.i + f.k - 1] AS win FROM px JOIN firsts f ON px.w[px.i] = f.w1 WHERE px.i + f.k - 1 <= len(px.w)),
m AS (SELECT dx.doc_id, dx.i, dx.k, bx.item_id FROM dx JOIN bx ON bx.k = dx.k AND bx.win = dx.win),
h AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS pos FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM m) GROUP BY doc_id)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id)"""

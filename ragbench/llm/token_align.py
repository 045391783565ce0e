"""Alignment of two tokenizers over the same bytes, by interval coalescing.

A is a byte-level BPE (tokenizers' json file), B a sentencepiece BPE with byte fallback. All tokens of A and B are
intervals of one byte axis: sorted by start, with a running maximum of their ends, a group breaks where a start reaches that
maximum, and overlaps are expanded within. Both tokenizers end a token before every space between two characters that
are not white space (A's split pattern does, B has no piece with a space behind another character), so a text's tokens
are those of its words; a block of documents puts each distinct word on the axis once. Tests hold this against both
libraries on whole texts.

Counts of id pairs are numbers of documents. A block of documents (some ``BLOCK_BYTES`` of text) counts its own pairs, Spark
adds the blocks' counts by pair, and every block gets the counts of its own pairs back. Of A's highest counts there are
at most as many as A has ids, which bounds what is broadcast.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import cached_property
from hashlib import sha256
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragbench.llm.common import Columns, stored

FOLDER = "/opt/tokenizers"
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text in a block (a longer document is a block of its own), and links (before repeats go) that are expanded at once.
BLOCK_BYTES, PART_LINKS = 3 << 19, 1 << 18
#: Bytes given to the tokenizers at once, and the length from which a word goes alone.
CHUNK, LONG = 20_000, 2_000
# The published split pattern of A's kind of tokenizer, and B's sign for a space.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPACE_SIGN = "▁"
WORDS = re.compile(r"(?<=\S) (?=\S)")
BITS = 16

OUT = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else the next from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Tokenizers:
    """Both tokenizers, from the contents of their files."""

    def __init__(self, a_file: bytes, b_file: bytes):
        import sentencepiece
        import tiktoken

        letters = byte_letters()
        known = json.loads(a_file)
        special = {x["content"] for x in known["added_tokens"]}
        vocabulary = {bytes(letters[c] for c in token): i for token, i in known["model"]["vocab"].items() if token not in special}
        del known
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = token
        # The ids are the ranks of the merges; this library is quicker, the other one takes words of any length.
        self.quick = tiktoken.Encoding("A", pat_str=PATTERN, mergeable_ranks=vocabulary, special_tokens={})
        self.a_file = a_file
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_file)
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else b"" if self.b.is_control(i) else piece.replace(SPACE_SIGN, " ").encode())
        if len(self.a_bytes) > 1 << BITS or len(self.b_bytes) > 1 << BITS:
            raise ValueError(f"vocabularies of more than {1 << BITS} ids")
        self.a_size, self.b_size = (np.array([len(x) for x in xs], dtype=np.int64) for xs in (self.a_bytes, self.b_bytes))
        self.written = [f"{i}{sign}" for sign in (",", "|", ";", "") for i in range(1 << BITS)]
        self.written_size = np.array([len(x) for x in self.written], dtype=np.int64)

    @cached_property
    def slow(self):
        from tokenizers import Tokenizer

        out = Tokenizer.from_str(self.a_file.decode())
        out.encode_special_tokens = True
        return out

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of space+text in A and of text in B (which adds the space), or None if either's bytes differ from space+text."""
        if SPACE_SIGN in text:
            return None
        a = self.slow.encode(" " + text, add_special_tokens=False).ids if len(text) > LONG and not WORDS.search(text) else self.quick.encode_ordinary(" " + text)
        b = self.b.encode(text, num_threads=1)
        data = b" " + text.encode()
        if b"".join(map(self.b_bytes.__getitem__, b)) != data:
            return None
        a, b = np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)
        # A's vocabulary holds every byte, and merges lose none.
        return (a, b) if self.a_size[a].sum() == len(data) else None


#: A worker's tokenizers, by the digest of their files: tasks after the first find them loaded.
_HELD: dict[str, Tokenizers] = {}


def _loaded(files: tuple[str, Broadcast]) -> Tokenizers:
    digest, data = files
    if digest not in _HELD:
        _HELD.clear()
        _HELD[digest] = Tokenizers(*data.value)
    return _HELD[digest]


class Words:
    """Tokens, groups and links of distinct words, each with the space before it."""

    def __init__(self, tokenizers: Tokenizers, words: list[str]):
        n, sizes = len(words), np.array([len(w.encode()) for w in words], dtype=np.int64) + 1
        self.odd = np.zeros(n, dtype=bool)
        ids: tuple[list, list] = ([], [])
        ends: tuple[list, list] = ([], [])
        start_of = np.cumsum(sizes) - sizes

        def put(first: int, last: int) -> bool:
            found = tokenizers.encode(" ".join(words[first:last]))
            for side, size in ((0, tokenizers.a_size), (1, tokenizers.b_size)) if found else ():
                ids[side].append(found[side])
                ends[side].append(start_of[first] + np.cumsum(size[found[side]]))
            return found is not None

        # Words go to the tokenizers in runs of some bytes; those that are long or end in white space go alone.
        alone = (sizes > LONG) | np.array([w[-1].isspace() for w in words], dtype=bool)
        run = start_of // CHUNK
        cuts = np.flatnonzero(np.concatenate(([True], (run[1:] != run[:-1]) | alone[1:] | alone[:-1]))) if n else []
        for first, last in zip(cuts, [*cuts[1:], n]):
            if not put(int(first), int(last)):
                for k in range(first, last):
                    self.odd[k] = last - first == 1 or not put(k, k + 1)
        a, b = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in ids)
        ids = None
        size_a, size_b = tokenizers.a_size[a], tokenizers.b_size[b]
        end_a, end_b = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in ends)
        ends = None
        start_a, start_b = end_a - size_a, end_b - size_b

        # All tokens by start; a group ends where a start reaches the furthest end so far.
        side = np.repeat(np.array([0, 1], dtype=np.int8), (len(a), len(b)))
        start, end, token = np.concatenate((start_a, start_b)), np.concatenate((end_a, end_b)), np.concatenate((a, b))
        order = np.lexsort((side, start))
        start, reach = start[order], np.maximum.accumulate(end[order])
        breaks = np.ones(len(order), dtype=bool)
        breaks[1:] = start[1:] >= reach[:-1]
        group = np.cumsum(breaks) - 1
        word = np.searchsorted(start_of, start, "right") - 1
        count = lambda mask: np.bincount(word[mask], minlength=n)
        self.n_a, self.n_b, self.n_groups = count(side[order] == 0), count(side[order] == 1), count(breaks)

        # Overlaps: B's tokens that end behind the start of A's token and start before its end.
        low, high = np.searchsorted(end_b, start_a, "right"), np.searchsorted(start_b, end_a, "left")
        width = high - low
        at = np.repeat(low - (np.cumsum(width) - width), width) + np.arange(width.sum())
        self.links = (np.repeat(a, width) << BITS | b[at]).astype(np.uint32)
        self.n_links = np.bincount(np.repeat(np.searchsorted(start_of, start_a, "right") - 1, width), minlength=n)
        self.link_at = np.concatenate(([0], np.cumsum(self.n_links)))

        # a1,a2|b1;a3|b2: each id with the sign behind it.
        by = np.lexsort((start, side[order], group))
        token, side, group, word = token[order][by], side[order][by], group[by], word[by]
        sign = np.full(len(token), 3, dtype=np.int64)
        sign[:-1] = np.where(word[1:] != word[:-1], 3, np.where(group[1:] != group[:-1], 2, np.where(side[1:] != side[:-1], 1, 0)))
        token |= sign << BITS
        flat = "".join(map(tokenizers.written.__getitem__, token.tolist()))
        upto = np.concatenate(([0], np.cumsum(tokenizers.written_size[token])))[np.searchsorted(word, np.arange(n + 1))].tolist()
        self.text = [flat[i:j] for i, j in zip(upto, upto[1:])]


def _distinct(numbers: np.ndarray) -> np.ndarray:
    numbers = np.sort(numbers)
    return numbers[np.concatenate(([True], numbers[1:] != numbers[:-1]))] if len(numbers) else numbers


class _Numbers(dict):
    """Numbers keys as they come."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


class Block:
    """Some documents: what is theirs alone, their words and the pairs in them."""

    def __init__(self, tokenizers: Tokenizers, texts: list[str | None]):
        numbers = _Numbers()
        held = [np.fromiter(map(numbers.__getitem__, WORDS.split(t)), dtype=np.int32) if t else np.zeros(0, dtype=np.int32) for t in texts]
        self.words = Words(tokenizers, list(numbers))
        if self.words.odd.any():
            held = [x[:0] if self.words.odd[x].any() else x for x in held]
        self.n_words = np.array([len(x) for x in held], dtype=np.int64)
        self.word = np.concatenate(held) if held else np.zeros(0, dtype=np.int32)
        self.doc = np.repeat(np.arange(len(texts), dtype=np.int64), self.n_words)
        self.digest = [sha256(";".join(map(self.words.text.__getitem__, x.tolist())).encode()).hexdigest() if len(x) else "" for x in held]

    def sums(self, of_word: np.ndarray) -> np.ndarray:
        """By document, the sum over its words."""
        upto = np.concatenate(([0], np.cumsum(of_word[self.word].astype(np.int64))))
        ends = np.cumsum(self.n_words)
        return upto[ends] - upto[ends - self.n_words]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs, the number of documents with each, and each link's place among them."""
        pairs = _distinct(self.words.links)
        place = np.searchsorted(pairs, self.words.links)
        docs = np.zeros(len(pairs), dtype=np.int64)
        # Documents by parts of some bytes, so that their pairs don't stand beside one another all at once.
        cost = np.cumsum(self.sums(self.words.n_links))
        part = cost // PART_LINKS
        for p in np.unique(part):
            mine = np.flatnonzero(part == p)
            rows = slice(int(np.searchsorted(self.doc, mine[0])), int(np.searchsorted(self.doc, mine[-1], "right")))
            once = _distinct(self.doc[rows] << 32 | self.word[rows])
            doc, word = once >> 32, once & 0xFFFFFFFF
            width = self.words.n_links[word]
            at = np.repeat(self.words.link_at[word] - (np.cumsum(width) - width), width) + np.arange(width.sum())
            docs += np.bincount(_distinct(np.repeat(doc, width) << 32 | place[at]) & 0xFFFFFFFF, minlength=len(pairs))
        return pairs, docs, place.astype(np.int32)


def _pack(*arrays: np.ndarray) -> bytes:
    """Numbers below 2**31, byte planes apart, as these compress."""
    sizes = np.array([len(x) for x in arrays], dtype=np.int32)
    flat = np.concatenate([sizes, *(x.astype(np.int32) for x in arrays)])
    return zlib.compress(np.ascontiguousarray(flat.view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unpack(data: bytes, n: int) -> list[np.ndarray]:
    flat = np.ascontiguousarray(np.frombuffer(zlib.decompress(data), dtype=np.uint8).reshape(4, -1).T).view(np.int32).reshape(-1)
    cuts = n + np.cumsum(flat[:n])
    return [flat[e - s : e] for s, e in zip(flat[:n], cuts, strict=True)]


def _blocks(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[tuple[pa.Table, list[str | None]]]:
    """Columns other than the last, and the last one's texts, in pieces of some bytes of text."""
    held: list = []
    texts: list = []
    size = 0
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.columns[-1]), 0).to_numpy(zero_copy_only=False)
        at = 0
        while at < len(sizes):
            upto = np.searchsorted(size + np.cumsum(sizes[at:]), block_bytes, "right") + at
            upto = max(upto, at + (size == 0))  # a document longer than a block is a block of its own
            if upto > at:
                held.append(batch.slice(at, upto - at).select(list(range(batch.num_columns - 1))))
                texts += batch.columns[-1].slice(at, upto - at).to_pylist()
                size += int(sizes[at:upto].sum())
                at = upto
            if at < len(sizes):
                yield pa.Table.from_batches(held), texts
                held, texts, size = [], [], 0
    if held:
        yield pa.Table.from_batches(held), texts


def _files(spark, folder: str, a_file: str, b_file: str) -> tuple[str, Broadcast]:
    """Both vocabulary files, of a few megabytes, read where the driver is, and their digest."""
    data = tuple(Path(folder, name).read_bytes() for name in (a_file, b_file))
    return sha256(b"".join(data)).hexdigest(), spark.sparkContext.broadcast(data)


def token_groups(docs: DataFrame, text: str = "text", folder: str = FOLDER, a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """All rows and columns with ``groups``, an array of (a: ids, b: ids): the least runs of tokens that cover the same bytes.

    Null and empty texts, and texts whose tokens' bytes differ from space+text, have no groups. No shuffle. Columns named
    like the output are replaced, all others stay, whatever their names; an empty table gives an empty table.
    """
    table = Columns(docs)
    files = _files(docs.sparkSession, folder, a_file, b_file)
    at = table.names.index(text) if text in table.names else int(table.name(text)[1:])
    schema = T.StructType([*table.rows.schema.fields, T.StructField("groups", T._parse_datatype_string("array<struct<a:array<int>,b:array<int>>>"))])

    def run(batches):
        t = _loaded(files)
        for batch in batches:
            out = []
            for text in batch.columns[at].to_pylist():
                block = Block(t, [text])
                groups = [g.split("|") for w in block.word for g in block.words.text[w].split(";")]
                out.append([{"a": list(map(int, a.split(","))), "b": list(map(int, b.split(",")))} for a, b in groups])
            kind = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, kind)], [*batch.schema.names, "groups"])

    return table.done(table.rows.mapInArrow(run, schema), {"groups": "groups"})


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(pair, count): in how many documents an id of A overlaps an id of B. pair is A's id times 65536 and B's id."""
    one = blocks.select(F.explode(F.arrays_zip("pairs", "docs")).alias("x")).select("x.pairs", "x.docs")
    return one.groupBy(F.col("pairs").alias("pair")).agg(F.sum("docs").alias("count"))


def block_table(rows: DataFrame, files: tuple[str, Broadcast], block_bytes: int) -> DataFrame:
    """The rows (text last) by blocks, with their own figures, and one row for each block with its pairs and packed words."""
    kept = rows.schema.fields[:-1]
    schema = T.StructType([T.StructField("block", T.LongType()), *(T.StructField(f.name, f.dataType) for f in kept), *T._parse_datatype_string(f"{OUT}, no int, pairs array<long>, docs array<long>, packed binary").fields])

    def run(batches):
        from pyspark import TaskContext

        t, part = _loaded(files), TaskContext.get().partitionId()
        for number, (columns, texts) in enumerate(_blocks(batches, block_bytes)):
            block, n = Block(t, texts), len(texts)
            name = part << 32 | number
            figures = [block.sums(x) for x in (block.words.n_a, block.words.n_b, block.words.n_groups, block.words.n_links)]
            pairs, docs, place = block.pairs()
            none = lambda k: [pa.nulls(k, x) for x in (pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())]
            arrays = [pa.array(np.full(n, name)), *(c.combine_chunks() for c in columns.columns), *map(pa.array, figures), pa.array(block.digest, pa.string()), pa.array(np.arange(n, dtype=np.int32)), *none(n)]
            arrays = [x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in arrays]
            names = [f.name for f in schema.fields]
            yield pa.RecordBatch.from_arrays(arrays, names)
            packed = _pack(block.n_words, block.word, block.words.n_links, place)
            own = [pa.array([x], pa.list_(pa.int64())) for x in (pairs.astype(np.int64), docs)]
            yield pa.RecordBatch.from_arrays([pa.array([name]), *(pa.nulls(1, x.type) for x in arrays[1:-4]), pa.array([-1], pa.int32()), *own, pa.array([packed], pa.binary())], names)

    return stored(rows.mapInArrow(run, schema), "token-blocks")


def align(docs: DataFrame, text: str = "text", keep: tuple[str, ...] | None = None, folder: str = FOLDER, a_file: str = A_FILE, b_file: str = B_FILE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All rows with n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256, and the columns ``keep`` (all but the text).

    A link is a token of A and one of B that share bytes; its count is the number of documents that hold its two ids so
    linked; it is best if no other pair of its A id has a higher count (ties are all best). Null and empty texts, and texts whose tokens'
    bytes differ from space+text, have zeros and an empty digest, and count nowhere. Texts are taken whole. Repeated rows
    are documents of their own. Columns named like outputs are replaced, all others stay, whatever their names; an empty
    table gives an empty table.
    """
    table = Columns(docs.select(*(c for c in docs.columns if keep is None or c in (*keep, text))))
    text_at = table.name(text)
    rows = table.rows.select(*(c for c in table.rows.columns if c != text_at), text_at)
    files = _files(docs.sparkSession, folder, a_file, b_file)
    blocks = block_table(rows, files, block_bytes)
    counts = stored(pair_counts(blocks.where("no = -1")), "pair-counts")
    # At most as many rows as A has ids.
    most = counts.groupBy(F.shiftright("pair", BITS).alias("a")).agg(F.max("count").alias("most"))
    counts = counts.join(F.broadcast(most), F.shiftright("pair", BITS) == F.col("a")).select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    held = blocks.where("no = -1").select("block", F.explode("pairs").alias("pair"))
    back = held.join(counts.hint("shuffle_merge"), "pair").select(F.col("block").alias("of_block"), "pair", "count", "best")
    kept = [f for f in rows.schema.fields if f.name != text_at]
    given = T._parse_datatype_string(f"{OUT}, n_best long, count_sum long")
    schema = T.StructType([*kept, *given.fields])
    count = len(kept)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.take(pc.sort_indices(left["no"]))
        n_words, word, n_links, place = _unpack(left["packed"][0].as_py(), 4)
        order = np.argsort(right["pair"].to_numpy())
        best, counted = right["best"].to_numpy()[order].astype(np.int64), right["count"].to_numpy()[order]
        link_at, ends = np.concatenate(([0], np.cumsum(n_links))), np.cumsum(n_words)
        sums = []
        for value in (best, counted):
            upto = np.concatenate(([0], np.cumsum(value[place])))
            of_word = (upto[link_at[1:]] - upto[link_at[:-1]])[word]
            upto = np.concatenate(([0], np.cumsum(of_word)))
            sums.append(pa.array(upto[ends] - upto[ends - n_words]))
        docs = left.slice(1)
        return pa.Table.from_arrays([*(docs.column(1 + k) for k in range(count)), *(docs[c] for c in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")), *sums], names=schema.names)

    out = blocks.drop("pairs", "docs").groupBy("block").cogroup(back.groupBy("of_block")).applyInArrow(finish, schema)
    return table.done(out.withColumn(text_at, F.lit(None)), {c: c for c in given.names}, without=(text,))


def op12_token_alignment(docs: DataFrame) -> DataFrame:
    """Contract of the query: every document's figures."""
    out = align(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")

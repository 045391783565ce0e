"""Documents to chunks. Every chunker takes (doc, text) rows and returns (doc, chunk_index, text)."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ragbench.functions.text import words
from ragbench.functions.vectors import cosine, hash_embedding

SCHEMA = "doc long, chunk_index int, text string"


def _indexed(rows: DataFrame, order: str) -> DataFrame:
    """Numbers from 0 within a document, after empty pieces are gone."""
    kept = rows.where(F.btrim("text") != "")
    return kept.select("doc", (F.row_number().over(Window.partitionBy("doc").orderBy(order)) - 1).cast("int").alias("chunk_index"), F.btrim("text").alias("text"))


def fixed(docs: DataFrame, size: int = 1000, overlap: int = 100) -> DataFrame:
    """Character windows of ``size`` that start every size - overlap characters; stripped, empty ones dropped."""
    starts = F.sequence(F.lit(0), F.greatest(F.length("text") - overlap - 1, F.lit(0)), F.lit(size - overlap))
    pieces = docs.where("text is not null").select("doc", F.explode(starts).alias("at"), F.col("text").alias("whole"))
    return _indexed(pieces.select("doc", "at", F.expr(f"substring(whole, at + 1, {size})").alias("text")), "at")


def tokens(docs: DataFrame, size: int = 256, overlap: int = 20, split: Callable = words) -> DataFrame:
    """Windows of ``size`` tokens; ``split`` gives the tokens of a text (words by default)."""
    cut = docs.where("text is not null").select("doc", split(F.col("text")).alias("t")).where(F.size("t") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("t") - overlap - 1, F.lit(0)), F.lit(size - overlap))
    return _indexed(cut.select("doc", F.explode(starts).alias("at"), "t").select("doc", "at", F.array_join(F.slice("t", F.col("at") + 1, size), " ").alias("text")), "at")


#: Fixed value: the published split pattern of vocabularies given as ranks.
RANKS_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_ENCODINGS: dict[str, object] = {}


def _encoding(digest: str, ranks: bytes):
    """A worker's encoding of these ranks, loaded once."""
    if digest not in _ENCODINGS:
        import tiktoken

        pairs = (line.split() for line in ranks.splitlines() if line)
        _ENCODINGS[digest] = tiktoken.Encoding("ranks", pat_str=RANKS_PATTERN, mergeable_ranks={base64.b64decode(token): int(rank) for token, rank in pairs}, special_tokens={})
    return _ENCODINGS[digest]


def token_windows(ids: list[int], size: int, overlap: int) -> list[list[int]]:
    """Windows that start every size - overlap tokens; the last one is the first that reaches the end."""
    out = []
    for at in range(0, len(ids), size - overlap):
        out.append(ids[at : at + size])
        if at + size >= len(ids):
            break
    return out


def subword_tokens(docs: DataFrame, ranks_file: str, size: int = 256, overlap: int = 20) -> DataFrame:
    """Windows of ``size`` byte-pair tokens, decoded, from a vocabulary given as ranks (base64 token and rank a line, read where the driver is).

    A window that begins or ends within a character has a replacement mark there, as half a character has no text. Texts
    are encoded whole; null and empty ones have no windows. The columns are those of every chunker.
    """
    ranks = Path(ranks_file).read_bytes()
    digest, shared = hashlib.sha256(ranks).hexdigest(), docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = _encoding(digest, shared.value)

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for doc, text in zip(batch["doc"], batch["text"], strict=True):
                    pieces = (encoding.decode(w, errors="replace") for w in token_windows(encoding.encode_ordinary(text), size, overlap))
                    yield from ((doc, i, t) for i, t in enumerate(p for p in pieces if p.strip()))

        yield from _frames(rows(), ["doc", "chunk_index", "text"])

    return docs.where("text is not null AND text <> ''").select("doc", "text").mapInPandas(run, SCHEMA)


def _recurse(text: str, size: int, separators: tuple[str, ...]) -> list[str]:
    """Pieces of at most ``size`` characters, cut at the first separator that the text has, else at the next finer one."""
    if len(text) <= size:
        return [text]
    for k, separator in enumerate(separators):
        if separator and separator in text:
            parts = text.split(separator)
            parts = [p + separator for p in parts[:-1]] + parts[-1:]
            return [x for p in parts if p for x in _recurse(p, size, separators[k + 1 :])]
    return [text[i : i + size] for i in range(0, len(text), size)]


def _merged(pieces: list[str], size: int, overlap: int) -> list[str]:
    """Neighbouring pieces joined up to ``size``; each chunk begins with whole pieces of its predecessor, ``overlap`` characters at most."""
    out, held, length = [], [], 0
    for piece in pieces:
        if held and length + len(piece) > size:
            out.append("".join(held))
            while held and (length > overlap or length + len(piece) > size):
                length -= len(held.pop(0))
        held.append(piece)
        length += len(piece)
    return out + (["".join(held)] if held else [])


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    columns = zip(*rows) if rows else ([], [], [])
    return pd.DataFrame({n: pd.Series(list(c), dtype="object" if n == "text" else "int64") for n, c in zip(names, columns)})


#: Characters of text in a frame that a task hands back.
FRAME = 1_000_000


def _frames(rows: Iterator[tuple], names: list[str]) -> Iterator[pd.DataFrame]:
    """Frames of some ``FRAME`` characters of text each (the last column), as one for each document takes time and one for a whole batch memory."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1])
        if size >= FRAME:
            yield _frame(held, names)
            held, size = [], 0
    yield _frame(held, names)


def split_recursive(text: str | None, size: int = 1000, overlap: int = 100, separators: tuple[str, ...] = ("\n\n", "\n", " ", "")) -> list[str]:
    return [x.strip() for x in _merged(_recurse(text or "", size, separators), size, overlap) if x.strip()]


def recursive(docs: DataFrame, size: int = 1000, overlap: int = 100) -> DataFrame:
    """Paragraphs, lines, words, then characters, merged up to ``size``. Rows are independent, so batches stream."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(doc, i, part) for doc, text in zip(batch["doc"], batch["text"]) for i, part in enumerate(split_recursive(text, size, overlap))]
            yield _frame(rows, ["doc", "chunk_index", "text"])

    return docs.select("doc", "text").mapInPandas(run, SCHEMA)


def markdown_sections(docs: DataFrame, levels: int = 6) -> DataFrame:
    """(doc, section, path, body): each heading opens a section, whose path is the stack of headings above it.

    A heading inside a code fence is text. A heading of level l is on the stack while no later one of its level or
    above has come. Sections without a body are left out.
    """
    lines = docs.where("text is not null").select("doc", F.posexplode(F.split("text", "\n", -1)).alias("no", "line"))
    upto = Window.partitionBy("doc").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    fence = F.col("line").rlike(r"^\s*```").cast("int")
    lines = lines.withColumn("fences", F.sum(fence).over(upto))
    title = (F.col("fences") % 2 == 0) & F.col("line").rlike(r"^#{1,6}\s+\S")
    lines = lines.withColumn("level", F.when(title, F.length(F.regexp_extract("line", "^(#+)", 1))))
    for k in range(1, levels + 1):
        lines = lines.withColumn(f"p{k}", F.last(F.when(F.col("level") == k, F.struct("no", "line")), True).over(upto))
    lines = lines.withColumn("section", F.sum(F.col("level").isNotNull().cast("int")).over(upto))
    stack = []
    for k in range(1, levels + 1):
        live = F.lit(True)
        for j in range(1, k):
            live = live & (F.col(f"p{k}.no") > F.coalesce(F.col(f"p{j}.no"), F.lit(-1)))
        stack.append(F.when(F.col(f"p{k}").isNotNull() & live, F.col(f"p{k}.line")))
    path = F.array_join(F.array_compact(F.array(*stack)), "\n")
    lines = lines.withColumn("path", path)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("level").isNull(), F.struct("no", "line")))), lambda x: x["line"]), "\n")
    out = lines.groupBy("doc", "section").agg(F.max("path").alias("path"), F.btrim(body).alias("body"))
    return out.where("body != ''")


def markdown(docs: DataFrame, size: int = 1000, overlap: int = 100) -> DataFrame:
    """Sections with their path in front; a long body is split recursively within what the path leaves."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for doc, section, path, body in zip(batch["doc"], batch["section"], batch["path"], batch["body"]):
                    head = f"{path}\n\n" if path else ""
                    budget = max(size - len(head), size // 4)
                    parts = [body] if len(head) + len(body) <= size else split_recursive(body, budget, min(overlap, budget // 2))
                    yield from ((doc, section * 1_000_000 + i, head + p) for i, p in enumerate(parts))

        yield from _frames(rows(), ["doc", "at", "text"])

    return _indexed(markdown_sections(docs).select("doc", "section", "path", "body").mapInPandas(run, "doc long, at long, text string"), "at")


def sentences(docs: DataFrame) -> DataFrame:
    """(doc, no, sentence): cut at white space after . ! or ?"""
    cut = docs.where("text is not null").select("doc", F.posexplode(F.split(F.btrim("text"), r"(?<=[.!?])\s+", -1)).alias("no", "sentence"))
    return cut.where(F.btrim("sentence") != "")


def semantic(docs: DataFrame, percentile: float = 0.9, threshold: float | None = None, embed=hash_embedding) -> DataFrame:
    """Cut between neighbouring sentences whose distance exceeds the document's percentile (0.5 if there is one distance only).

    Distances count to 12 places and the percentile between them to 13, so that equal ones stay equal however they were rounded on the way.
    """
    rows = sentences(docs)
    vectors = rows.select("sentence").distinct().withColumn("v", embed(F.col("sentence")))
    by_doc = Window.partitionBy("doc")
    rows = rows.join(vectors.hint("merge"), "sentence").withColumn("d", F.round(1 - cosine(F.col("v"), F.lag("v").over(by_doc.orderBy("no"))), 12))
    limit = F.when(F.count("d").over(by_doc) == 1, 0.5).otherwise(F.round(F.percentile("d", percentile).over(by_doc), 13)) if threshold is None else F.lit(threshold)
    rows = rows.withColumn("cut", F.coalesce((F.col("d") > limit).cast("int"), F.lit(0)))
    rows = rows.withColumn("part", F.sum("cut").over(by_doc.orderBy("no").rowsBetween(Window.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "sentence"))), lambda x: x["sentence"]), " ")
    return _indexed(rows.groupBy("doc", "part").agg(text.alias("text")), "part")


CHUNKERS: dict[str, Callable[[DataFrame], DataFrame]] = {"fixed": fixed, "recursive": recursive, "token": tokens, "markdown": markdown, "semantic": semantic}


def ingest(docs: DataFrame, chunkings: list[str], embeddings: dict[str, Callable]) -> DataFrame:
    """Every chunking with every embedding: (chunking, embedding, chunk_id, doc, chunk_index, text, vector)."""
    parts = None
    for chunking in chunkings:
        chunks = CHUNKERS[chunking](docs)
        for name, embed in embeddings.items():
            one = chunks.select(F.lit(chunking).alias("chunking"), F.lit(name).alias("embedding"), F.xxhash64("doc", "chunk_index").alias("chunk_id"), "doc", "chunk_index", "text", embed(F.col("text")).alias("vector"))
            parts = one if parts is None else parts.unionByName(one)
    return parts


def single_chunk_warnings(chunks: DataFrame, docs: DataFrame, least: int = 2000) -> DataFrame:
    """Documents longer than ``least`` characters that became one chunk."""
    single = chunks.groupBy("doc").count().where("count = 1").select("doc")
    return docs.where(F.length("text") > least).join(single.hint("merge"), "doc", "left_semi").select("doc", F.length("text").alias("n_chars"))

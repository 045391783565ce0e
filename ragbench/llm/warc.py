"""Deterministic sharded WARC archives: write, commit, read back.

Records are cut into shards by key range, sorted within a shard, and written as one gzip member each; a shard
rolls to its next file when the compressed size reaches a limit. Headers, record ids and digests are derived from
the data, so equal input gives equal bytes. The shards' bounds come from a sample that a hash of the key chooses,
not from Spark's own sampling, whose seed differs between runs.

Commit: each task attempt writes under names of its own in ``_temporary`` and returns one manifest row for each
file. Spark keeps the rows of one attempt only. The files that the manifest names are then renamed (a repeated
rename is harmless), and the manifest table, whose ``_SUCCESS`` is written last, makes the archive valid. Readers
open only files that the manifest names.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragbench.llm.common import new_path, stored

SHARD_BYTES, ROLL_BYTES, LEVEL = 64 << 20, 16 << 20, 6
#: Shards of an archive (beyond 3.2 TB of payload they grow), and keys of the sample that sets their bounds, about.
MOST_SHARDS, SAMPLE_KEYS = 50_000, 200_000
#: Fixed: the input has no fetch time, and headers must not differ between runs.
DATE = "1970-01-01T00:00:00Z"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "shard int, part int, name string, attempt string, records long, bytes long, sha256 string"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def target_uri(url: str | None, page_id: int | None) -> str:
    """The URL with white space and control characters escaped; a null URL becomes urn:page:<id>."""
    if not url:
        return f"urn:page:{page_id}"
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, lead: int | None) -> bytes:
    """One WARC record: a response with its payload, or (``lead`` given) a revisit of that page's response."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if lead is not None else http + payload
    head = {
        "WARC-Type": "response" if lead is None else "revisit", "WARC-Record-ID": record_id(page_id, digest), "WARC-Date": DATE,
        "WARC-Target-URI": target_uri(url, page_id), "WARC-Payload-Digest": f"sha1:{digest}", "WARC-Block-Digest": f"sha1:{base32_sha1(block)}",
    }
    if lead is not None:
        head |= {"WARC-Profile": _REVISIT, "WARC-Refers-To": record_id(lead, digest), "X-Refers-To-Page": lead}
    head |= {"X-Page": "" if page_id is None else page_id, "X-Payload-Length": size, "Content-Type": "application/http; msgtype=response", "Content-Length": len(block)}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def marked(pages: DataFrame, page_id: str, url: str, payload: str, least_bytes: int) -> DataFrame:
    """Page rows (kind 1), and for each (page_id, digest) that revisits another page a narrow row before them (kind 0) with ``lead``.

    Both go through one shuffle to their shard, where the writer puts them together: payloads are never joined.
    """
    data = F.coalesce(F.col(payload).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), data.alias("data"))
    rows = rows.withColumn("size", F.octet_length("data").cast("long")).withColumn("digest", F.unhex(F.sha1("data")))
    narrow = rows.where((F.col("size") >= least_bytes) & F.col("page_id").isNotNull()).select("page_id", "size", "digest")
    firsts = narrow.groupBy("digest", "size").agg(F.min("page_id").alias("lead"), F.max("page_id").alias("last")).where("lead < last").drop("last")
    marks = narrow.join(stored(firsts, "firsts").hint("merge"), ["digest", "size"]).where("lead < page_id").select("page_id", "digest", "lead").distinct()
    return rows.withColumn("kind", F.lit(1)).unionByName(marks.withColumn("kind", F.lit(0)), allowMissingColumns=True)


def _bounds(pages: DataFrame, page_id: str, payload: str, shard_bytes: int) -> np.ndarray:
    """Keys at which a new shard begins, at about equal payload bytes (repeated payloads included); the same for equal tables."""
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.coalesce(F.octet_length(payload), F.lit(0)).cast("long").alias("size"))
    total = rows.agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).first()
    shards = min(MOST_SHARDS, max(1, -(-(total["bytes"] or 0) // shard_bytes)))
    if shards == 1:
        return np.zeros(0, dtype=np.int64)
    rate = min(1_000_000, int(1e6 * SAMPLE_KEYS / total["n"]) + 1)
    sample = rows.where(F.col("page_id").isNotNull() & (F.pmod(F.xxhash64("page_id"), F.lit(1_000_000)) < rate))
    found = np.array(sorted((r[0], r[1]) for r in sample.select("page_id", "size").collect()), dtype=np.int64).reshape(-1, 2)
    if not len(found):
        return np.zeros(0, dtype=np.int64)
    upto = np.cumsum(found[:, 1] + 1)
    return np.unique(found[np.searchsorted(upto, upto[-1] * np.arange(1, shards) / shards), 0])


def _shard(bounds: np.ndarray) -> Column:
    """The shard of a key; rows without one, which have no order, are dealt by their digest."""
    def number(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, keys.to_numpy(np.int64), side="right").astype(np.int32))

    ranged = F.pandas_udf(number, T.IntegerType())(F.coalesce("page_id", F.lit(0)))
    return F.when(F.col("page_id").isNotNull(), ranged).otherwise(F.pmod(F.xxhash64("digest"), F.lit(len(bounds) + 1)).cast("int"))


def write_archive(pages: DataFrame, out: str, page_id: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write one record for each row under ``out`` (a folder that all executors share) and return the manifest.

    A null payload is empty. Of rows with equal payloads of at least ``least_bytes``, that with the smallest id is
    the response and the others revisit it; repeated rows with that id are all responses, and rows without an id
    are responses, dealt to shards by their digest. Other columns are not archived. An empty table gives a manifest
    without rows. Tables with a column named like an inner one are fine, as only the three named columns are read. A
    payload is in a task's memory a few times, one record at a time. Each shard is one partition, so the largest task
    holds one shard: ``shard_bytes``, or the payloads of one id where that is more. What failed or repeated attempts
    left behind is deleted once the manifest is there.
    """
    spark = pages.sparkSession
    rows = marked(pages, page_id, url, payload, least_bytes)
    bounds = _bounds(pages, page_id, payload, shard_bytes)
    work, final = f"{out}/_temporary", f"{out}/data"

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        attempt, store = uuid.uuid4().hex, None
        shard, part, sink, digest, size, records = None, 0, None, None, 0, 0
        mark: tuple = ()
        done: list[tuple] = []

        def close() -> None:
            sink.close()
            done.append((shard, part, f"shard-{shard:06d}-{part:05d}.warc.gz", f"{attempt}-{shard}-{part}", records, size, digest.hexdigest()))

        for batch in batches:
            for s, p, u, data, n, d, lead, kind in zip(*(batch[c] for c in ("shard", "page", "url", "data", "size", "digest", "lead", "kind"))):
                p = None if p is None else int(p)
                if kind == 0:
                    mark = (p, bytes(d), int(lead))
                    continue
                lead = mark[2] if mark[:2] == (p, bytes(d)) else None
                if sink is not None and (s != shard or size >= roll_bytes):
                    close()
                    part = part + 1 if s == shard else 0
                    sink = None
                if sink is None:
                    if store is None:
                        store, root = _open(work)
                        store.create_dir(root, recursive=True)
                    part = part if s == shard else 0
                    shard, digest, size, records = s, hashlib.sha256(), 0, 0
                    sink = store.open_output_stream(f"{root}/{attempt}-{shard}-{part}")
                one = _member(record(p, u, bytes(data), int(n), base64.b32encode(bytes(d)).decode(), lead))
                sink.write(one)
                digest.update(one)
                size, records = size + len(one), records + 1
            if done:
                yield pd.DataFrame(done, columns=[c.split()[0] for c in MANIFEST.split(", ")])
                done = []
        if sink is not None:
            close()
        if done:
            yield pd.DataFrame(done, columns=[c.split()[0] for c in MANIFEST.split(", ")])

    sharded = rows.withColumn("shard", _shard(bounds)).repartitionById(len(bounds) + 1, "shard").sortWithinPartitions("shard", "page_id", "digest", "kind", "url")
    # Ids go to Python as text: a column with nulls would come as floats, which can't hold all of them.
    texts = sharded.select("shard", F.col("page_id").cast("string").alias("page"), "url", "data", "size", "digest", F.col("lead").cast("string").alias("lead"), "kind")
    written = stored(texts.mapInPandas(write, MANIFEST), "manifest")

    def commit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            store, source = _open(work)
            target = _open(final)[1]
            store.create_dir(target, recursive=True)
            for attempt, name in zip(batch["attempt"], batch["name"]):
                if store.get_file_info(f"{source}/{attempt}").type != fs.FileType.NotFound:
                    store.move(f"{source}/{attempt}", f"{target}/{name}")
            yield batch

    written.mapInPandas(commit, MANIFEST).write.parquet(f"{out}/manifest")
    left = spark._jvm.org.apache.hadoop.fs.Path(work)
    left.getFileSystem(spark._jsc.hadoopConfiguration()).delete(left, True)
    return spark.read.schema(written.schema).parquet(f"{out}/manifest")


def records_of(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each gzip member; reads in pieces, so an archive never is in memory as a whole."""
    z, data, rest = zlib.decompressobj(31), bytearray(), b""
    while True:
        piece = rest or stream.read(1 << 16)
        if not piece:
            break
        data += z.decompress(piece)
        rest = b""
        if z.eof:
            rest = z.unused_data
            head, _, body = bytes(data).partition(b"\r\n\r\n")
            fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            yield fields, body[: int(fields["Content-Length"])]
            z, data = zlib.decompressobj(31), bytearray()
    if data:
        raise ValueError("the archive ends within a record")


def read_archive(spark: SparkSession, out: str) -> DataFrame:
    """One row for each record of a committed archive; digests are computed anew and must equal the headers'."""
    final = f"{out}/data"
    files = spark.read.parquet(f"{out}/manifest").select("name", "records")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = _open(final)
        for batch in batches:
            for name, expected in zip(batch["name"], batch["records"]):
                rows, n = [], 0
                with store.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for head, block in records_of(stream):
                        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                        if head["WARC-Type"] == "response" and base32_sha1(block.partition(b"\r\n\r\n")[2]) != digest:
                            raise ValueError(f"{name}: the payload of {head['WARC-Record-ID']} doesn't have its digest")
                        lead = head.get("X-Refers-To-Page")
                        rows.append((int(head["X-Page"]) if head["X-Page"] else None, int(head["X-Payload-Length"]), digest, head["WARC-Type"], int(lead) if lead else None))
                        if len(rows) == 5000:
                            n += len(rows)
                            yield _frame(rows)
                            rows = []
                n += len(rows)
                if n != expected:
                    raise ValueError(f"{name} has {n} records; the manifest says {expected}")
                yield _frame(rows)

    # Enough partitions that each holds a few files.
    return files.repartition(max(1, spark.sparkContext.defaultParallelism), "name").mapInPandas(read, RECORDS)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in RECORDS.split(", ")])
    return out.astype({"page_id": "Int64", "refers_to": "Int64"})


def op2_warc(pages: DataFrame) -> DataFrame:
    """Contract of the query: write all pages, then read the archives back."""
    out = new_path(pages.sparkSession, "warc")
    write_archive(pages, out)
    return read_archive(pages.sparkSession, out)


#: DuckDB SQL for the query (base 32 spelt out from the digest's 160 bits).
ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS n, sha1(h) AS s, h FROM p),
b AS (SELECT page_id, n, s, min(page_id) OVER (PARTITION BY s, n) AS lead,
  list_reduce(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(CAST(substr(
    list_reduce(list_transform(range(1, 41), lambda k: substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * (instr('0123456789abcdef', substr(s, k, 1)) - 1) + 1, 4)), lambda x, y: concat(x, y)), 5 * i + 1, 5) AS BIT) AS INTEGER), 1)), lambda x, y: concat(x, y)) AS digest FROM d)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN lead < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN lead < page_id THEN lead END AS refers_to
FROM b"""

"""An index table that grows and shrinks by commits: nothing is rewritten or recounted.

Rows lie below ``chunks`` by commit, base, chunking and embedding. The table ``commits`` has one row for each index that a commit
appended to, with the first id and the number of rows, and one for each base that was deleted. Commits are numbered; a commit counts once its rows
in ``commits``, one file, are there, so an attempt that failed has no effect, whatever it wrote. Ids of an index go on
from its last committed one, and begin anew after its base was deleted. One writer at a time.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragbench.operators.ordered import RANGE, in_ranges, running_sums

INDEX = ["base", "chunking", "embedding"]
COMMITS = "number long, commit string, base string, chunking string, embedding string, first long, n long, deletes boolean"


def commits(spark: SparkSession, place: str) -> DataFrame:
    try:
        return spark.read.schema(COMMITS).parquet(f"{place}/commits")
    except AnalysisException:
        return spark.createDataFrame([], COMMITS)


def _record(rows: DataFrame, place: str) -> None:
    rows.select(*(c.split()[0] for c in COMMITS.split(", "))).coalesce(1).write.mode("append").parquet(f"{place}/commits")


def _live(log: DataFrame) -> DataFrame:
    """Appends that no later delete of their base has ended. The log has a row for each commit and index."""
    gone = log.where("deletes").groupBy(F.col("base").alias("of")).agg(F.max("number").alias("ended"))
    return log.where("not deletes").join(gone, F.col("base").eqNullSafe(F.col("of")), "left").where("ended is null or number > ended").drop("of", "ended")


def append(chunks: DataFrame, place: str) -> None:
    """Number and append chunks (base, chunking, embedding, doc, chunk_index, ...): ids go on by (doc, chunk_index) within each index.

    A running count over ranges numbers the rows, so an index of any size is numbered by many tasks.
    """
    spark = chunks.sparkSession
    log = commits(spark, place)
    number, commit = (log.agg(F.max("number")).first()[0] or 0) + 1, uuid.uuid4().hex
    held = _live(log).groupBy(*(F.col(c).alias(f"of_{c}") for c in INDEX)).agg(F.sum("n").alias("held"))
    order = [*INDEX, "doc", "chunk_index"]
    rows = running_sums(in_ranges(chunks, order, "numbered"), order, {"place": F.lit(1)}, INDEX).drop(RANGE)
    same = F.lit(True)
    for c in INDEX:
        same = same & F.col(c).eqNullSafe(F.col(f"of_{c}"))
    numbered = rows.join(held, same, "left").withColumn("chunk_id", F.col("place") - 1 + F.coalesce("held", F.lit(0))).drop("place", "held", *(f"of_{c}" for c in INDEX))
    numbered.withColumn("ingested_at", F.current_timestamp()).write.partitionBy(*INDEX).parquet(f"{place}/chunks/commit={commit}")
    written = spark.read.option("basePath", f"{place}/chunks").parquet(f"{place}/chunks/commit={commit}")
    new = written.groupBy(*(F.col(c).cast("string").alias(c) for c in INDEX)).agg(F.min("chunk_id").alias("first"), F.count(F.lit(1)).alias("n"))
    _record(new.select(F.lit(number).cast("long").alias("number"), F.lit(commit).alias("commit"), *INDEX, "first", "n", F.lit(False).alias("deletes")), place)


def delete_base(spark: SparkSession, place: str, base: str) -> None:
    """End all indexes of a base, by its exact name: one row in the log, no rows are read."""
    number = (commits(spark, place).agg(F.max("number")).first()[0] or 0) + 1
    _record(spark.createDataFrame([(number, uuid.uuid4().hex, base, None, None, None, None, True)], COMMITS), place)


def chunks(spark: SparkSession, place: str) -> DataFrame:
    """All committed rows of bases that weren't deleted since; folders of other commits and bases are not read."""
    live = _live(commits(spark, place)).select(F.col("commit").alias("of_commit"), *(F.col(c).alias(f"of_{c}") for c in INDEX))
    rows = spark.read.option("basePath", f"{place}/chunks").option("mergeSchema", "true").parquet(f"{place}/chunks")
    same = F.col("commit") == F.col("of_commit")
    for c in INDEX:
        same = same & F.col(c).cast("string").eqNullSafe(F.col(f"of_{c}"))
    return rows.join(live, same, "left_semi").drop("commit")


def vacuum(spark: SparkSession, place: str) -> int:
    """Delete the folders of what no longer counts (failed attempts, deleted bases); how many went. Not while a commit is under way."""
    live = {tuple(r) for r in _live(commits(spark, place)).select("commit", "base").distinct().collect()}  # a row for each commit and base
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{place}/chunks")
    store, gone = root.getFileSystem(spark._jsc.hadoopConfiguration()), 0
    for commit in store.listStatus(root):
        name = commit.getPath().getName().removeprefix("commit=")
        kept = False
        for base in store.listStatus(commit.getPath()):
            if not base.isDirectory():
                continue
            value = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(base.getPath().getName().removeprefix("base="))
            if (name, None if value == "__HIVE_DEFAULT_PARTITION__" else value) in live:
                kept = True
            else:
                store.delete(base.getPath(), True)
                gone += 1
        if not kept:
            store.delete(commit.getPath(), True)
    return gone

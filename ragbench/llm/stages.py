"""Operators as stages over a table of documents: each takes and returns the columns of ``documents``.

For all of them: an empty table gives an empty table; any columns may be null; further columns stay as they are,
also those that an operator names its outputs by (the work runs under numbered names); repeated rows are documents
of their own, but for the near-duplicate stage; texts are taken whole, whatever their length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragbench.llm.common import SPACE, Columns
from ragbench.llm.common import table as tables
from ragbench.llm.contamination import contaminate
from ragbench.llm.line_dedup import dedup_lines
from ragbench.llm.mixing import mix
from ragbench.llm.near_dup import near_duplicates
from ragbench.llm.quality import score_quality


def _around(docs: DataFrame) -> tuple[Columns, dict[str, str]]:
    table = Columns(docs)
    return table, {c: table.name(c) for c in ("doc_id", "text")}


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null, empty and very short texts go, as they fail the base rules."""
    table, at = _around(docs)
    return table.done(score_quality(table.rows, at["text"]).where("kept"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later repeated runs; a document of which no word is left goes. n_chars, if there, follows the text.

    Null and empty texts have no runs and stay. Of equal runs that in the smallest doc_id stays (a null one is the
    smallest); rows that are equal in id and text keep or lose the same lines.
    """
    table, at = _around(docs)
    found = dedup_lines(table.rows, at["text"], at["doc_id"])
    left = found.where((F.col("n_removed") == 0) | (F.btrim(at["text"], F.lit(SPACE)) != ""))
    if "n_chars" not in docs.columns:
        return table.done(left)
    chars = table.name("n_chars")
    follows = F.when(F.col("n_removed") > 0, F.length(at["text"])).otherwise(F.col(chars))
    return table.done(left, changed={chars: follows.cast(docs.schema["n_chars"].dataType)})


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (shingles of five words, 0.8): that with the smallest id.

    Null texts, texts without words and rows without an id stay. Rows that share the smallest id stay all.
    """
    table, at = _around(docs)
    return table.done(near_duplicates(table.rows, at["text"], at["doc_id"]).where("kept"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not hold benchmark passages. Null and empty texts have no words and stay."""
    table, at = _around(docs)
    return table.done(contaminate(table.rows, tables(spark, sf_dir, "benchmark"), at["text"]).where("not contaminated"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their place in the mix (columns block, slot and place, which replace any of these names)."""
    return mix(docs)

"""From raw documents to a training mix: five stages, each written as Parquet and reread by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ragbench.llm.common import stored, table
from ragbench.llm.stages import decontamination_stage, line_dedup_stage, mixing_stage, near_dup_stage, quality_stage

STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]
#: Expectation-maximisation, sketches and the schedule are not SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

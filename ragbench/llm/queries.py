"""Registered queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ragbench.llm.common import table


def _op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ragbench.llm.toxicity import op1_toxicity

    return op1_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ragbench.llm.warc import op2_warc

    return op2_warc(table(spark, sf_dir, "pages"))


def _op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ragbench.llm.language import op3_language

    return op3_language(table(spark, sf_dir, "documents"))


def _op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ragbench.llm.quality import op4_quality_rules

    return op4_quality_rules(table(spark, sf_dir, "documents"))


def _op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ragbench.llm.line_dedup import op5_line_dedup

    return op5_line_dedup(table(spark, sf_dir, "documents"))


def _op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ragbench.llm.near_dup import op6_near_duplicates

    return op6_near_duplicates(table(spark, sf_dir, "documents"))


def _op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ragbench.llm.mixing import op7_mixing

    return op7_mixing(table(spark, sf_dir, "documents"))


def _op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ragbench.llm.licenses import op8_licence_scan

    return op8_licence_scan(table(spark, sf_dir, "documents"))


def _op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ragbench.llm.secrets import op9_secret_scan

    return op9_secret_scan(table(spark, sf_dir, "documents"))


def _op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ragbench.llm.contamination import op10_decontamination

    return op10_decontamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ragbench.llm.conversation_trie import op11_prefix_trie

    return op11_prefix_trie(table(spark, sf_dir, "conversations"))


def _op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ragbench.llm.token_align import op12_token_alignment

    return op12_token_alignment(table(spark, sf_dir, "documents"))


def _op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ragbench.llm.url_rules import op13_url_filter

    return op13_url_filter(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": _op1,
        "op2_warc": _op2,
        "op3_language": _op3,
        "op4_quality_rules": _op4,
        "op5_line_dedup": _op5,
        "op6_near_duplicates": _op6,
        "op7_mixing": _op7,
        "op8_licence_scan": _op8,
        "op9_secret_scan": _op9,
        "op10_decontamination": _op10,
        "op11_prefix_trie": _op11,
        "op12_token_alignment": _op12,
        "op13_url_filter": _op13,
    }


def oracle_sql() -> dict[str, str]:
    from ragbench.llm import contamination, conversation_trie, licenses, line_dedup, secrets, url_rules, warc

    return {
        "op2_warc": warc.ORACLE,
        "op5_line_dedup": line_dedup.ORACLE,
        "op8_licence_scan": licenses.oracle(),
        "op9_secret_scan": secrets.oracle(),
        "op10_decontamination": contamination.ORACLE,
        "op11_prefix_trie": conversation_trie.ORACLE,
        "op13_url_filter": url_rules.oracle(),
    }

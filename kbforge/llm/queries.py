"""Queries of this subpackage: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kbforge.llm import lm_scoring

    return lm_scoring.op1(_table(spark, sf_dir, "documents"))


def _op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kbforge.llm import packing

    return packing.op2(_table(spark, sf_dir, "documents"))


def _op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kbforge.llm import token_files

    return token_files.op3(_table(spark, sf_dir, "documents"))


def _op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kbforge.llm import substring_dedup

    return substring_dedup.op4(_table(spark, sf_dir, "documents"))


def _op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kbforge.llm import transport_stream

    return transport_stream.op5(_table(spark, sf_dir, "documents"))


def _op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kbforge.llm import near_dedup

    return near_dedup.op6(_table(spark, sf_dir, "documents"))


def _op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kbforge.llm import pii

    return pii.op7(_table(spark, sf_dir, "documents"))


def _op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kbforge.llm import quality_rules

    return quality_rules.op8(_table(spark, sf_dir, "documents"))


def _op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kbforge.llm import bpe_chunks

    return bpe_chunks.op9(_table(spark, sf_dir, "documents"))


def _op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kbforge.llm import quality_classifier

    return quality_classifier.op10(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def _op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kbforge.llm import decontamination

    return decontamination.op11(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def _op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kbforge.llm import lexical_search

    return lexical_search.op12(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def _op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kbforge.llm import merkle

    return merkle.op13(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_lm_scoring": _op1,
        "op2_packing": _op2,
        "op3_token_files": _op3,
        "op4_substring_dedup": _op4,
        "op5_transport_stream": _op5,
        "op6_near_dedup": _op6,
        "op7_pii": _op7,
        "op8_quality_rules": _op8,
        "op9_bpe_chunks": _op9,
        "op10_quality_classifier": _op10,
        "op11_decontamination": _op11,
        "op12_lexical_search": _op12,
        "op13_merkle_manifest": _op13,
    }


def oracle_sql() -> dict[str, str]:
    from kbforge.llm import oracles

    return oracles.oracle_sql()

"""The subpackage's queries: each applies an operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from heronlake.llm import compaction, decontamination, language_id, mixing, ngram_join, ppm, quality_rules, token_files, warc_zip, weak_labels
from heronlake.session import read_spread, ship


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return read_spread(spark, f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.pairs(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.digest(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "documents"))


def op3_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.digest(_table(spark, sf_dir, "documents"))


def op4_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_labels.digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(_table(spark, sf_dir, "documents"))


def op6_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compaction.digest(_table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_zip.write_and_read(_table(spark, sf_dir, "pages"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.write_and_read(_table(spark, sf_dir, "documents"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.digest(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontamination, op2_language_id, op3_ppm, op4_weak_labels, op5_mixing, op6_compaction, op7_quality_rules, op8_warc_zip, op9_token_files, op10_ngram_join)}


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": decontamination.ORACLE, "op10_ngram_join": ngram_join.ORACLE, "op5_mixing": mixing.ORACLE, "op8_warc_zip": warc_zip.ORACLE}

"""A training corpus in five stages, each over all that the one before kept.

Null and empty texts have too few words and go in the first stage, so that later stages
see none; a null id passes all stages by its text alone. Of rows that repeat an id one is
left after near duplicates. Documents that tie for a group's first do so by id, the least
stays. Very long texts are whole in every stage. An empty table gives no rows, and columns
beyond those of documents are carried through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from heronlake.llm import _store, compaction, decontamination, mixing, ngram_join, quality_rules
from heronlake.session import ship


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the learned list keep."""
    return quality_rules.keep(docs, _table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links over five-word shingles at 0.8 or more."""
    ship(spark)
    return ngram_join.first_of_groups(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    return decontamination.clean(docs, _table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them."""
    return mixing.mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus in compacted shards, as its last manifest has it."""
    return compaction.digest(docs)


STAGES = [("quality_rules", rules), ("near_duplicates", near_duplicates), ("decontamination", decontaminate), ("mixing", mix), ("sharding", shard)]
#: No SQL: the learned list, the similarity join and the shards are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = _table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, path = _store.kept_table(stage(spark, docs, sf_dir), f"stage-{name}")
        if before:
            _store.drop(spark, before)  # the next stage's table is whole
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)

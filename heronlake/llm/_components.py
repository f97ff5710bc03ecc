"""Connected components of a distributed edge table by alternating stars; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronlake.llm import _store


def _large(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours point at the least of its neighbourhood."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours point at the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _sum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(links: DataFrame) -> tuple[DataFrame, str]:
    """From ``a, b`` rows, ``node, component`` (its least node) for each node but the least ones; the table's path.

    Rounds are logarithmic in the longest path; each is written to the shared folder.
    """
    spark = links.sparkSession
    first = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, path = _store.kept_table(first, "edges")
    before = _sum(edges)
    while before[0]:
        nxt, there = _store.kept_table(_small(_large(edges)), "edges")
        _store.drop(spark, path)
        edges, path, now = nxt, there, _sum(nxt)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")), path

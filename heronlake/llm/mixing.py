"""Mixing sources to target weights by hash-threshold histograms.

Every document has a fixed hash. A source that is to give ``full`` whole passes and a
rest takes all its documents ``full`` times and, once more, those whose hash is below a
threshold at which the sizes below it come nearest to the rest. Thresholds are found by
nested histograms: sizes are summed by source and hash bucket, the bucket in which the
rest runs out is opened and only its documents are summed by the next bits, until the
bucket is one hash. Documents are then filtered; they are never sorted, and a hot source
is only ever summed (partial sums before the shuffle).

Null text has size 0; null source is a source of its own, last in order; null ids share
one hash. Rows with the same id share their hash and are taken together. Empty tables
give empty results. Ties at a threshold cannot occur between different hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from heronlake.llm import _store

WORD = r"[^\x20\x09-\x0D]+"
HASH_BITS, LEVEL_BITS = 60, 12
WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2.0


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def key_hash(doc_id: Column, seed: str = "mix") -> Column:
    """60 bits of MD5, so that other engines can recompute it."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), key_hash(F.col("doc_id")).alias("h"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``source, source_size, target``, a row a source.

    The target is the smaller of ``most`` times the size and weight times a level common
    to all sources, chosen so that targets sum to ``share`` of all sizes; this is where
    sharing the excess of capped sources again and again by weight ends.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Win.orderBy(F.col("source").asc_nulls_last())) - 1  # one row a source
    cases = F.lit(weights[-1])
    for i, w in enumerate(weights[:-1]):
        cases = F.when(rank % len(weights) == i, F.lit(float(w))).otherwise(cases)
    by = by.withColumn("weight", cases)
    order = Win.orderBy((most * F.col("source_size")) / F.col("weight"), F.col("source").asc_nulls_last())
    by = by.withColumn("capped", F.coalesce(F.sum(most * F.col("source_size")).over(order.rowsBetween(Win.unboundedPreceding, -1)), F.lit(0.0)))
    by = by.withColumn("open", F.sum("weight").over(order.rowsBetween(0, Win.unboundedFollowing)))
    whole = Win.partitionBy(F.lit(1))
    by = by.withColumn("budget", share * F.sum("source_size").over(whole))
    by = by.withColumn("level", F.greatest(F.max((F.col("budget") - F.col("capped")) / F.col("open")).over(whole), F.lit(0.0)))
    return by.select("source", "source_size", F.least(most * F.col("source_size"), F.col("level") * F.col("weight")).alias("target"))


def thresholds(sizes: DataFrame, goals: DataFrame) -> DataFrame:
    """``goals`` with ``full`` passes and the hash ``below`` which documents are taken once more."""
    spark = sizes.sparkSession
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    state, path = _store.kept_table(
        goals.withColumn("full", full).withColumn("rest", F.col("target") - F.col("full") * F.col("source_size"))
        .select("*", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("prior"), F.lit(0).cast("long").alias("own"), F.lit(True).alias("open")), "goals"
    )
    for shift in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        inner = state.where("open").select(F.col("source").alias("s"), "prefix", "prior", "rest")
        inside = sizes.join(inner, sizes["source"].eqNullSafe(F.col("s")) & (F.shiftright("h", shift + LEVEL_BITS) == F.col("prefix")))
        buckets = inside.groupBy("s", "prior", "rest", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("size"), F.min("h").alias("least"), F.max("h").alias("last"))
        run = F.col("prior") + F.sum("size").over(Win.partitionBy("s").orderBy("bucket"))  # at most 2**LEVEL_BITS rows a source
        crossed = buckets.withColumn("run", run).where(F.col("run") > F.col("rest"))
        crossed = crossed.groupBy("s").agg(F.min_by(F.struct("bucket", "run", "size", "least", "last"), "bucket").alias("b"))
        # A source that never crosses takes all; a bucket with one hash needs no further levels.
        done = F.col("b.least") == F.col("b.last")
        nxt = state.join(crossed, state["source"].eqNullSafe(F.col("s")), "left").select(
            "source", "source_size", "target", "full", "rest",
            F.when(~F.col("open"), F.col("prefix")).when(F.col("b").isNull(), F.lit(1 << HASH_BITS)).when(done, F.col("b.least")).otherwise(F.col("b.bucket")).alias("prefix"),
            F.when(F.col("b").isNotNull(), F.col("b.run") - F.col("b.size")).otherwise(F.col("prior")).alias("prior"),
            F.when(F.col("b").isNotNull(), F.col("b.size")).otherwise(F.col("own")).alias("own"),
            (F.col("open") & F.col("b").isNotNull() & ~done).alias("open"),
        )
        old = path
        state, path = _store.kept_table(nxt, "thresholds")
        _store.drop(spark, old)
        if state.where("open").isEmpty():
            break
    # The documents of the boundary hash are taken where that comes nearer to the rest.
    nearer = (F.col("own") > 0) & (F.col("prior") + F.col("own") - F.col("rest") < F.col("rest") - F.col("prior"))
    return state.select("source", "source_size", "target", "full", (F.col("prefix") + F.when(nearer, 1).otherwise(0)).alias("below"))


def passes(h: Column) -> Column:
    return F.col("full") + F.when(h < F.col("below"), 1).otherwise(0)


def digest(docs: DataFrame) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` and the ``passes`` over each document."""
    sizes, _ = _store.kept_table(sized(docs), "sizes")
    plan = thresholds(sizes, targets(sizes)).withColumnRenamed("source", "s")
    return sizes.join(plan, sizes["source"].eqNullSafe(F.col("s"))).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * passes(F.col("h"))).alias("taken"), passes(F.col("h")).alias("passes")
    )


def mix(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them; documents of size 0 add nothing to it and stay once."""
    sizes, path = _store.kept_table(sized(docs), "sizes")
    plan = thresholds(sizes, targets(sizes)).select(F.struct(F.col("source").alias("s"), "full", "below").alias("__plan"))
    _store.drop(docs.sparkSession, path)
    times = F.when(n_words(F.col("text")) == 0, 1).otherwise(F.col("__plan.full") + F.when(key_hash(F.col("doc_id")) < F.col("__plan.below"), 1).otherwise(0))
    joined = docs.join(plan, docs["source"].eqNullSafe(F.col("__plan.s"))).withColumn("__times", times).where(F.col("__times") > 0)
    return joined.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times").cast("int")))).select(*docs.columns)


ORACLE = """
WITH s AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
by_source AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source),
weighed AS (SELECT *, [5.0, 2.0, 1.0][1 + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT]::DOUBLE AS weight FROM by_source),
caps AS (
  SELECT *, coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
         sum(weight) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open,
         1.5::DOUBLE * sum(source_size) OVER () AS budget FROM weighed),
goals AS (SELECT source, source_size, least(2.0::DOUBLE * source_size, greatest((max((budget - capped) / open) OVER ()), 0) * weight) AS target FROM caps),
plan AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS full FROM goals),
hashes AS (SELECT s.source, h, sum(size) AS own FROM s GROUP BY s.source, h),
run AS (SELECT hashes.*, sum(own) OVER (PARTITION BY hashes.source ORDER BY h) AS run FROM hashes),
edge AS (
  SELECT p.source, min(r.h) AS h, arg_min(r.run - r.own, r.h) AS prior, arg_min(r.own, r.h) AS own
  FROM plan p JOIN run r ON p.source IS NOT DISTINCT FROM r.source WHERE r.run > p.target - p.full * p.source_size GROUP BY p.source),
cut AS (
  SELECT p.*, CASE WHEN e.h IS NULL THEN 1::BIGINT << 60
    WHEN e.own > 0 AND e.prior + e.own - (p.target - p.full * p.source_size) < p.target - p.full * p.source_size - e.prior THEN e.h + 1 ELSE e.h END AS below
  FROM plan p LEFT JOIN edge e ON p.source IS NOT DISTINCT FROM e.source)
SELECT s.doc_id, s.size, c.source_size, c.target, s.size * (c.full + (s.h < c.below)::BIGINT) AS taken, c.full + (s.h < c.below)::BIGINT AS passes
FROM s JOIN cut c ON s.source IS NOT DISTINCT FROM c.source
"""

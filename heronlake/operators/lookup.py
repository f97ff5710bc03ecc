"""Iterative lookups over a replay log of answers, for many targets at once.

A round asks the nearest unasked nodes of each target, adds what they answer and keeps
the nearest; each round's table is checkpointed, so that lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from heronlake.functions import ids
from heronlake.operators import routing
from heronlake.sources import tables


def _cut(df: DataFrame) -> DataFrame:
    tables.shared_dir(df.sparkSession)  # sets a checkpoint folder where the session has none
    return df.checkpoint()


def _nearest(rows: DataFrame, k: int, name: str) -> DataFrame:
    by = Win.partitionBy("target").orderBy(ids.xor(F.col("node_id"), F.col("target")), "node_id")
    return rows.withColumn(name, F.row_number().over(by)).where(F.col(name) <= k)


def rounds_of(starts: DataFrame, answers: DataFrame, k: int = 8, alpha: int = 3, rounds: int | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """``target, node_id, asked`` at the end (:func:`iterate`), and ``target, node_id`` of those asked in each round."""
    state, log = _cut(starts.select("target", "node_id").distinct().withColumn("asked", F.lit(False))), []
    while rounds is None or len(log) < rounds:
        near = _nearest(state, k, "r").drop("r")
        ask = _cut(_nearest(near.where(~F.col("asked")), alpha, "a").select("target", "node_id"))
        if ask.isEmpty():
            break
        log.append(ask)
        found = ask.join(answers, "node_id").select("target", F.col("found_id").alias("node_id"), F.lit(False).alias("asked"))
        told = ask.withColumn("asked", F.lit(True))
        merged = state.unionByName(told).unionByName(found).groupBy("target", "node_id").agg(F.max("asked").alias("asked"))
        state = _cut(_nearest(merged, k, "r").drop("r"))
    return state, log


def iterate(starts: DataFrame, answers: DataFrame, k: int = 8, alpha: int = 3, rounds: int | None = None) -> DataFrame:
    """``target, node_id, asked`` when no unasked node is among the k nearest, or after ``rounds``.

    ``starts``: ``target, node_id``; ``answers``: ``node_id, found_id``, a row for each node in an answer.
    """
    return rounds_of(starts, answers, k, alpha, rounds)[0]


def peers_found(starts: DataFrame, answers: DataFrame, peers: DataFrame, k: int = 8, alpha: int = 3, rounds: int = 3) -> DataFrame:
    """``target, node_id, ip, port``: all peers that asked nodes gave (``peers``: ``node_id, ip, port``, and ``target`` if answers differ by it), repeats kept; those of nodes that nearer ones displaced too."""
    _, log = rounds_of(starts, answers, k, alpha, rounds)
    asked = starts.select("target", "node_id").limit(0)
    for ask in log:
        asked = asked.unionByName(ask)
    return asked.distinct().join(peers, [c for c in ("target", "node_id") if c in peers.columns]).select("target", "node_id", "ip", "port")


def crawl_round(ready: DataFrame, seen: DataFrame, found: DataFrame, target: str, width: int) -> tuple[DataFrame, DataFrame]:
    """The next ready queue and seen set: new nodes by distance to the target, trimmed to the width."""
    new = found.select("node_id").distinct().join(seen.select("node_id"), "node_id", "left_anti")
    both = ready.select("node_id").unionByName(new).withColumn("target", F.lit(target))
    return _nearest(both, width, "r").select("node_id"), seen.select("node_id").unionByName(new)


def push_ready(found: DataFrame, seen: DataFrame, samples: DataFrame, target: str) -> DataFrame:
    """``node_id, target, dist, yield_factor`` of nodes that were not seen; the yield is what they sampled before (``samples``: ``node_id, n``)."""
    new = found.select("node_id").distinct().join(seen.select("node_id"), "node_id", "left_anti").join(samples.select("node_id", "n"), "node_id", "left")
    return new.select("node_id", F.lit(target).alias("target"), ids.xor_hex(F.col("node_id"), F.lit(target)).alias("dist"), F.coalesce("n", F.lit(0)).cast("double").alias("yield_factor"))


def cool_down(asked: DataFrame, now: Column, default: int, least_interval: int, most_interval: int, most_failures: int, most_jitter: int, round_: int) -> DataFrame:
    """``node_id, failures, dropped, next_allowed`` after a round (``asked``: ``node_id, ok, failures, interval, num, returned``).

    A failure cools for the default time and, from ``most_failures`` on, drops the node; a
    success clears its failures and cools for the interval that the node asked for, within
    bounds, or within twice the least if it has more samples than it gave. Jitter is added.
    """
    failures = F.when(F.col("ok"), 0).otherwise(F.col("failures") + 1)
    wait = ids.shorten_interval(ids.clamp_interval(F.coalesce("interval", F.lit(0)), least_interval, least_interval, most_interval), F.coalesce("num", F.lit(0)), F.coalesce("returned", F.lit(0)), least_interval)
    seconds = F.when(F.col("ok"), wait).otherwise(F.lit(default)) + ids.jitter(F.col("node_id"), F.lit(round_), most_jitter)
    dropped = ~F.col("ok") & (F.col("failures") + 1 >= most_failures)
    return asked.select("node_id", failures.cast("long").alias("failures"), dropped.alias("dropped"), F.when(~dropped, now + F.make_dt_interval(secs=seconds.cast("double"))).alias("next_allowed"))


def rotates(round_: int, every: int) -> bool:
    """Whether the crawl takes a new target after this round."""
    return every > 0 and round_ % every == 0


def schedule(ready: DataFrame, cooling: DataFrame, now: Column, alpha: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The nodes to ask now (``alpha`` of those ready or cooled, by weighted distance), the rest of the ready ones, and those that still cool."""
    due = F.col("next_allowed") <= now
    waiting = ready.unionByName(cooling.where(due).select(*ready.columns))
    batch = _cut(routing.ready_order(waiting, alpha).select(*ready.columns))
    return batch, waiting.join(batch.select("node_id"), "node_id", "left_anti").select(*ready.columns), cooling.where(~due)

"""Nearest nodes by XOR distance, buckets, queues and the routing table."""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heronlake.functions import ids
from heronlake.operators import sequential

PREFIX_BITS = 60  # the deepest prefix that nodes are counted by
SPARE_BITS = 8  # counted beyond the depth at which evenly spread ids would do


def _prefix(node: Column, depth: Column) -> Column:
    """The first ``depth`` bits of an id as a number."""
    return F.call_function("shiftrightunsigned", F.conv(F.substring(node, 1, 15), 16, 10).cast("long"), F.lit(PREFIX_BITS) - depth)


def nearest(targets: DataFrame, nodes: DataFrame, k: int, bad: int = 3) -> DataFrame:
    """``target, node_id, rank``: the k nearest good nodes of each target.

    A node that shares a longer prefix with the target is nearer. So nodes are counted by
    prefix, each target takes the longest of its own that k nodes or more share, and only
    these are ranked: equi-joins by prefix, of some k nodes a target.
    """
    good = nodes.where(F.col("failure_count") < bad).select("node_id").distinct()
    wanted = targets.select("target").where(F.col("target").isNotNull()).distinct()
    total = good.count()
    deepest = min(PREFIX_BITS, max(0, (total // max(k, 1)).bit_length()) + SPARE_BITS)
    depths = F.explode(F.sequence(F.lit(0), F.lit(deepest)))
    base = good.groupBy(_prefix(F.col("node_id"), F.lit(deepest)).alias("p")).agg(F.count("*").alias("n"))
    shorter = lambda p, depth: F.call_function("shiftrightunsigned", p, F.lit(deepest) - depth)
    counts = base.select("p", "n", depths.alias("depth")).groupBy("depth", shorter(F.col("p"), F.col("depth")).alias("prefix")).agg(F.sum("n").alias("n")).where((F.col("n") >= k) | (F.col("depth") == 0))
    own = wanted.select("target", depths.alias("depth")).withColumn("prefix", _prefix(F.col("target"), F.col("depth")))
    chosen = own.join(counts, ["depth", "prefix"]).groupBy("target").agg(F.max(F.struct("depth", "prefix")).alias("c")).select("target", "c.*")
    used = [r[0] for r in chosen.select("depth").distinct().collect()]  # at most PREFIX_BITS + 1
    held = good.select("node_id", F.explode(F.array(*map(F.lit, sorted(used))) if used else F.array().cast("array<int>")).alias("depth")).withColumn("prefix", _prefix(F.col("node_id"), F.col("depth")))
    rows = chosen.join(held, ["depth", "prefix"]).select("target", "node_id", ids.xor(F.col("node_id"), F.col("target")).alias("dist"))
    ranked = rows.withColumn("rank", F.row_number().over(Win.partitionBy("target").orderBy("dist", "node_id")))
    return ranked.where(F.col("rank") <= k).select("target", "node_id", "rank")


def bucket_of(nodes: DataFrame, buckets: DataFrame) -> DataFrame:
    """Each node with the bucket whose range holds it; a table has at most 161 buckets."""
    b = F.broadcast(buckets.select("bucket", "low", "high"))
    return nodes.join(b, ids.in_bucket(F.col("node_id"), F.col("low"), F.col("high"))).drop("low", "high")


def depth_buckets(own: str, depth: int) -> list[tuple[int, str, str]]:
    """``bucket, low, high`` of a table split ``depth`` times along its own id; a zero end is open."""
    n, cuts = int(own, 16), {0}
    for d in range(depth):
        cuts |= {n >> (160 - d) << (160 - d), (n >> (160 - d) << (160 - d)) + (1 << (159 - d))}
    lows = sorted(c for c in cuts if c < 1 << 160)
    return [(i, f"{low:040x}", f"{high:040x}") for i, (low, high) in enumerate(zip(lows, [*lows[1:], 0], strict=True))]


def stale_buckets(nodes: DataFrame, now: Column, seconds: int) -> DataFrame:
    """``bucket, low, high, last_changed`` rows that have not changed for so long."""
    return nodes.where(F.col("last_changed") < now - F.make_dt_interval(secs=F.lit(float(seconds))))


def scaled(distance: str, factor: float) -> str:
    """A distance times a factor, exactly, rounded down."""
    from fractions import Fraction

    return f"{int(int(distance, 16) * Fraction(factor)):040x}"


@F.pandas_udf(T.StringType())
def weighted(distance: pd.Series, yields: pd.Series) -> pd.Series:
    """Sort key: the distance times y/(y+1); zero yield leaves it."""
    from heronlake.operators.routing import scaled

    return pd.Series([d if not y or y <= 0 else scaled(d, y / (y + 1.0)) for d, y in zip(distance, yields, strict=True)])


def ready_order(items: DataFrame, width: int) -> DataFrame:
    """The ``width`` items that come first by weighted distance (``dist`` in hex, ``yield_factor``)."""
    return items.withColumn("key", weighted(F.col("dist"), F.col("yield_factor"))).orderBy("key", "node_id").limit(width)


def prune_seen(seen: DataFrame, cooling: DataFrame, width: int, cutoff: Column | None = None) -> DataFrame:
    """What cools down stays; of the others those before ``cutoff`` go, and then the oldest while more than four times the width are left."""
    kept = cooling.select("node_id").distinct().withColumn("__cools", F.lit(True))
    rows = seen.join(kept, "node_id", "left")
    if cutoff is not None:
        rows = rows.where(F.col("__cools").isNotNull() | (F.col("seen_at") >= cutoff))
    cooled = rows.where("__cools").drop("__cools")
    room = max(0, 4 * width - cooled.count())
    return cooled.unionByName(rows.where("__cools IS NULL").drop("__cools").orderBy(F.col("seen_at").desc(), F.col("node_id").desc()).limit(room))


def promote(cooling: DataFrame, now: Column) -> DataFrame:
    return cooling.where(F.col("next_allowed") <= now)


def sample_keys(keys: DataFrame, n: int = 500, seed: int = 0) -> DataFrame:
    """At most n keys, the same for a seed."""
    return keys.select("infohash").distinct().orderBy(F.md5(F.concat("infohash", F.lit(str(seed))).cast("binary")), "infohash").limit(n)


@dataclass
class Bucket:
    low: int
    high: int
    depth: int
    changed: float = 0.0
    nodes: list[dict] = field(default_factory=list)
    spare: list[dict] = field(default_factory=list)

    def holds(self, n: int) -> bool:
        return self.low <= n < self.high


@dataclass
class RoutingTable:
    """Sequential table of one node: splits only around its own id, keeps replacements, evicts what fails."""

    own: int
    size: int = 8
    bad: int = 2
    buckets: list[Bucket] = field(default_factory=lambda: [Bucket(0, 1 << 160, 0)])

    def bucket(self, n: int) -> Bucket:
        return next(b for b in self.buckets if b.holds(n))

    def insert(self, node_id: str, addr: str, at: float) -> str:
        n = int(node_id, 16)
        while True:
            b = self.bucket(n)
            for x in b.nodes:
                if x["id"] == node_id:
                    x.update(addr=addr, seen=at, failures=0)
                    return "updated"
            new = {"id": node_id, "addr": addr, "seen": at, "failures": 0}
            if len(b.nodes) < self.size:
                b.nodes.append(new)
                b.changed = at
                return "inserted"
            if not b.holds(self.own) or b.depth >= 160:
                break
            middle = (b.low + b.high) // 2
            halves = [Bucket(b.low, middle, b.depth + 1, at), Bucket(middle, b.high, b.depth + 1, at)]
            for h in halves:
                h.nodes = [x for x in b.nodes if h.holds(int(x["id"], 16))]
                h.spare = [x for x in b.spare if h.holds(int(x["id"], 16))]
            i = self.buckets.index(b)
            self.buckets[i : i + 1] = halves
        for x in b.spare:
            if x["id"] == node_id:
                x.update(addr=addr, seen=at, failures=0)
                return "updated"
        if len(b.spare) < self.size:
            b.spare.append(new)
            return "cached"
        return "dropped"

    def success(self, node_id: str, at: float) -> str:
        for x in self.bucket(int(node_id, 16)).nodes:
            if x["id"] == node_id:
                x.update(seen=at, failures=0)
                return "success"
        return "unknown"

    def failure(self, node_id: str, at: float) -> str:
        b = self.bucket(int(node_id, 16))
        for x in b.nodes:
            if x["id"] == node_id:
                x["failures"] += 1
                if x["failures"] < self.bad:
                    return "failed"
                b.nodes.remove(x)
                if b.spare:
                    b.nodes.append(b.spare.pop(0))
                b.changed = at
                return "evicted"
        for x in b.spare:
            if x["id"] == node_id:
                x["failures"] += 1
                if x["failures"] < self.bad:
                    return "failed"
                b.spare.remove(x)
                return "evicted"
        return "unknown"

    def apply(self, kind: str, node_id: str, addr: str, at: float) -> str:
        return self.insert(node_id, addr, at) if kind == "insert" else self.success(node_id, at) if kind == "success" else self.failure(node_id, at)


def replay(events: DataFrame, size: int = 8, bad: int = 2) -> DataFrame:
    """``own_id, seq, outcome`` for events (``own_id, seq, kind, node_id, addr, at``) of one table each, in order of ``seq``.

    A table is the state of one node and its events are sequential; tables run in parallel.
    """
    def step(table: RoutingTable, key: tuple, row: tuple):
        seq, kind, node_id, addr, at = row
        yield key[0], seq, table.apply(kind, node_id, addr, at)

    return sequential.fold(events.select("own_id", "seq", "kind", "node_id", "addr", "at"), ["own_id"], ["seq"], "own_id string, seq long, outcome string", lambda key: RoutingTable(int(key[0], 16), size, bad), step)


def table_sizes(events: DataFrame, size: int = 8, bad: int = 2) -> DataFrame:
    """``own_id, nodes, spare, buckets`` of the tables at the end of their events: active nodes, replacements and buckets."""
    def step(table: RoutingTable, key: tuple, row: tuple):
        _, kind, node_id, addr, at = row
        table.apply(kind, node_id, addr, at)
        return ()

    def end(table: RoutingTable, key: tuple):
        yield key[0], sum(len(b.nodes) for b in table.buckets), sum(len(b.spare) for b in table.buckets), len(table.buckets)

    return sequential.fold(events.select("own_id", "seq", "kind", "node_id", "addr", "at"), ["own_id"], ["seq"], "own_id string, nodes long, spare long, buckets long", lambda key: RoutingTable(int(key[0], 16), size, bad), step, end)

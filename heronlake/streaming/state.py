"""Keyed state: rotating dedup, peer store, rate limits. Each has a batch form over a whole log and a stream form.

Times are event times in the rows. A stream has a watermark (``late``: how far rows may be
behind the latest one; those that are further behind are dropped), which also ends the state
of silent keys by timers, once it no longer matters.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from heronlake.operators import sequential


def rotating_dedup(events: DataFrame, rotation_seconds: int, key: str = "infohash", ts: str = "seen_at", order: str = "event_id") -> DataFrame:
    """The events that two rotating sets let through: a key passes again only two rotations after it last did.

    Each key's rotations, not its events, are folded, so that a busy key stays small.
    """
    w = F.floor(F.unix_seconds(F.col(ts)) / rotation_seconds)
    first = events.withColumn("__w", w).groupBy(key, "__w").agg(F.min_by(F.struct(*events.columns), F.struct(ts, order)).alias("__e"))
    by = first.groupBy(key).agg(F.sort_array(F.collect_list("__w")).alias("__ws"))
    keep = F.aggregate("__ws", F.array().cast("array<bigint>"), lambda a, x: F.when(F.size(a) == 0, F.array(x)).when(x - F.element_at(a, -1) >= 2, F.concat(a, F.array(x))).otherwise(a))
    passed = by.select(key, F.explode(keep).alias("__w"))
    return first.join(passed, [key, "__w"]).select("__e.*")


class _Rotating(StatefulProcessor):
    def __init__(self, rotation: int):
        self.rotation = rotation

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "w long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        got = pd.concat(list(rows)).sort_values(["seen_at", "event_id"])
        last, out = (self.last.get()[0] if self.last.exists() else None), []
        for r in got.itertuples(index=False):
            w = int(r.seen_at.timestamp() // self.rotation)
            if last is None or w - last >= 2:
                out.append((key[0], int(r.event_id)))
                last = w
        if out:
            self.last.update((last,))
            self.handle.registerTimer((last + 2) * self.rotation * 1000)
        yield pd.DataFrame(out, columns=["infohash", "event_id"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.last.exists() and (self.last.get()[0] + 2) * self.rotation * 1000 <= expiredTimerInfo.getExpiryTimeInMs():
            self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def rotating_dedup_stream(events: DataFrame, rotation_seconds: int, late: str = "1 hour") -> DataFrame:
    """``infohash, event_id`` of the events that pass, from a stream of ``infohash, event_id, seen_at`` (needs the RocksDB state store)."""
    rows = events.select("infohash", "event_id", "seen_at").withWatermark("seen_at", late).groupBy("infohash")
    return rows.transformWithStateInPandas(_Rotating(rotation_seconds), "infohash string, event_id long", "Append", "EventTime")


class PeerStore:
    """Peers by hash, with caps on both and a time to live; events come in order of time.

    A peer that comes again is refreshed. A hash that is full takes no new peer; a store
    that is full lets go of the hash that came first, which when it comes again is new.
    What expires makes room.
    """

    def __init__(self, ttl: int, most_peers: int, most_hashes: int):
        self.ttl, self.most_peers, self.most_hashes = ttl, most_peers, most_hashes
        self.held: dict[str, dict[tuple, int]] = {}
        self.queue: deque[tuple[int, str, tuple]] = deque()

    def expire(self, now: int) -> None:
        while self.queue and self.queue[0][0] <= now - self.ttl:
            at, infohash, peer = self.queue.popleft()
            peers = self.held.get(infohash)
            if peers and peers.get(peer) == at:
                del peers[peer]
                if not peers:
                    del self.held[infohash]

    def add(self, infohash: str, peer: tuple, at: int) -> None:
        self.expire(at)
        peers = self.held.get(infohash)
        if peers is None:
            if len(self.held) >= self.most_hashes:
                del self.held[next(iter(self.held))]
            peers = self.held[infohash] = {}
        if peer in peers or len(peers) < self.most_peers:
            peers[peer] = at
            self.queue.append((at, infohash, peer))


def live_peers(events: DataFrame, now, ttl_seconds: int, most_peers: int, most_hashes: int | None, store: str | None = None) -> DataFrame:
    """``infohash, ip, port, seen_at`` (and the column ``store``, if stores are told apart by one): what a store holds at ``now`` after its announcements up to then.

    A store's evictions depend on all that came before, so one store is one sequence; it holds no more than its caps allow.
    Without a cap on hashes (None) none is evicted, hashes don't depend on each other, and each is a sequence of its own.
    """
    stores = [store] if store else []
    keys = stores if most_hashes is not None else [*stores, "infohash"]
    rows = events.where(F.col("seen_at") <= now).select(*stores, "infohash", F.unix_micros("seen_at").alias("at"), "event_id", "ip", F.col("port").cast("long").alias("port"))
    n = len(stores)

    def step(held: PeerStore, key: tuple, row: tuple):
        infohash, at, _, ip, port = (*key, *row)[n:]
        held.add(infohash, (ip, port), at)
        return ()

    def end(held: PeerStore, key: tuple):
        for infohash, peers in held.held.items():
            for (ip, port), at in peers.items():
                yield *key[:n], infohash, ip, port, at

    kind = f"{store} {events.schema[store].dataType.simpleString()}, " if store else ""
    got = sequential.fold(rows, keys, ["at", "event_id"], f"{kind}infohash string, ip string, port long, at long", lambda _: PeerStore(ttl_seconds * 1_000_000, most_peers, 1 if most_hashes is None else most_hashes), step, end)
    return got.where(F.col("at") > F.unix_micros(now) - ttl_seconds * 1_000_000).select(*stores, "infohash", "ip", "port", F.timestamp_micros("at").alias("seen_at"))


class _Peers(StatefulProcessor):
    def __init__(self, most: int, ttl: int):
        self.most, self.ttl = most, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.peers = handle.getMapState("peers", "ip string, port int", "seen_at double")

    def _expire(self, now: float) -> dict[tuple, float]:
        held = {(k[0], int(k[1])): float(v[0]) for k, v in self.peers.iterator()} if self.peers.exists() else {}
        for peer in [p for p, t in held.items() if t <= now - self.ttl]:
            self.peers.removeKey(peer)
            del held[peer]
        return held

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        got = pd.concat(list(rows)).sort_values(["seen_at", "event_id"])
        held = self._expire(got["seen_at"].iloc[0].timestamp())
        for r in got.itertuples(index=False):
            peer, now = (r.ip, int(r.port)), r.seen_at.timestamp()
            for gone in [p for p, t in held.items() if t <= now - self.ttl]:
                self.peers.removeKey(gone)
                del held[gone]
            if peer in held or len(held) < self.most:
                held[peer] = now
                self.peers.updateValue(peer, (now,))
        if held:
            self.handle.registerTimer(int((max(held.values()) + self.ttl) * 1000) + 1)
        yield pd.DataFrame({"infohash": [key[0]], "n_live": [len(held)]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self._expire(expiredTimerInfo.getExpiryTimeInMs() / 1000)
        yield pd.DataFrame({"infohash": [key[0]], "n_live": [len(held)]})

    def close(self) -> None:
        pass


def peer_store_stream(events: DataFrame, most_peers: int, ttl_seconds: int, late: str = "1 hour") -> DataFrame:
    """``infohash, n_live`` after each batch and each expiry, of a stream of ``infohash, ip, port, event_id, seen_at``; the bound on hashes, which all share, is :func:`live_peers`'s."""
    rows = events.select("infohash", "ip", "port", "event_id", "seen_at").withWatermark("seen_at", late)
    return rows.groupBy("infohash").transformWithStateInPandas(_Peers(most_peers, ttl_seconds), "infohash string, n_live long", "Update", "EventTime")


def bucket_decisions(times: list[float], rate: float, burst: int, start: tuple[float, float] | None = None, idle: float | None = None) -> tuple[list[bool], tuple[float, float]]:
    """Of a token bucket that starts full, and anew after ``idle`` seconds without an event, for events in order; its tokens and time at the end."""
    tokens, last = start or (float(burst), times[0] if times else 0.0)
    out = []
    for t in times:
        tokens = float(burst) if idle is not None and t - last > idle else min(float(burst), tokens + max(0.0, t - last) * rate)
        last = t
        out.append(tokens >= 1)
        tokens -= tokens >= 1
    return out, (tokens, last)


class Limiter:
    """Token buckets by key, of which so many fit; idle ones go, and a new key that finds no room is denied."""

    def __init__(self, rate: float, burst: int, idle: float | None = None, most: int | None = None):
        self.rate, self.burst, self.idle, self.most = rate, burst, idle, most
        self.buckets: dict[str, tuple[float, float]] = {}  # least recently seen first

    def allow(self, key: str | None, at: float) -> bool:
        if not key:
            return False
        if self.idle is not None:
            while self.buckets and at - next(iter(self.buckets.values()))[1] > self.idle:
                del self.buckets[next(iter(self.buckets))]
        if key not in self.buckets and self.most is not None and len(self.buckets) >= self.most:
            return False
        (ok,), self.buckets[key] = bucket_decisions([at], self.rate, self.burst, self.buckets.pop(key, None))
        return ok


def rate_limited(events: DataFrame, rate: float, burst: int, key: str = "ip", ts: str = "at", order: str = "seq", idle_seconds: float | None = None, most_keys: int | None = None) -> DataFrame:
    """``key, order, allowed``: a token bucket for each key; an empty key is never allowed. One key's events are sequential.

    With ``most_keys`` the table of keys is shared, and all events are one sequence; without, keys run in parallel.
    """
    rows = events.select(key, (F.unix_micros(ts) / 1e6).alias("__at"), F.col(order).cast("long").alias("__order"))

    def step(limiter: Limiter, k: tuple, row: tuple):
        name, at, n = (*k, *row) if most_keys is None else (row[0], row[1], row[2])
        yield name, n, limiter.allow(name, at)

    return sequential.fold(rows, [key] if most_keys is None else [], ["__at", "__order"], f"{key} string, {order} long, allowed boolean", lambda _: Limiter(rate, burst, idle_seconds, most_keys), step)


class _Limiter(StatefulProcessor):
    def __init__(self, rate: float, burst: int, idle: float):
        self.rate, self.burst, self.idle = rate, burst, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bucket = handle.getValueState("bucket", "tokens double, last double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        from heronlake.streaming.state import bucket_decisions

        got = pd.concat(list(rows)).sort_values(["at", "seq"])
        start = tuple(map(float, self.bucket.get())) if self.bucket.exists() else None
        ok, end = bucket_decisions([t.timestamp() for t in got["at"]], self.rate, self.burst, start, self.idle)
        self.bucket.update(end)
        self.handle.registerTimer(int((end[1] + self.idle) * 1000) + 1)
        yield pd.DataFrame({"ip": key[0], "seq": got["seq"].to_numpy(), "allowed": [a and bool(key[0]) for a in ok]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.bucket.exists() and (float(self.bucket.get()[1]) + self.idle) * 1000 < expiredTimerInfo.getExpiryTimeInMs():
            self.bucket.clear()
        return iter(())

    def close(self) -> None:
        pass


def rate_limited_stream(events: DataFrame, rate: float, burst: int, idle_seconds: float = 3600.0, late: str = "1 hour") -> DataFrame:
    """As :func:`rate_limited` with idle buckets, for a stream of ``ip, seq, at``; without a cap on keys, which all share."""
    return events.select("ip", "seq", "at").withWatermark("at", late).groupBy("ip").transformWithStateInPandas(_Limiter(rate, burst, idle_seconds), "ip string, seq long, allowed boolean", "Append", "EventTime")


def ttl_latest(events: DataFrame, now, ttl_seconds: int, key: str, value: str, ts: str) -> DataFrame:
    """The latest value of each key that is no older than the time to live."""
    got = events.groupBy(key).agg(F.max_by(value, ts).alias(value), F.max(ts).alias(ts))
    return got.where(F.col(ts) > now - F.make_dt_interval(secs=F.lit(float(ttl_seconds))))

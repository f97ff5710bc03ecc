"""Collectors as aggregates: counters, gauges and cumulative histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def exponential(start: float, factor: float, n: int) -> list[float]:
    return [start * factor**i for i in range(n)]


#: Bucket bounds: request times, lookups, fetches, and peers in a set.
SUB_SECOND, LOOKUPS, FETCHES = exponential(0.001, 2, 12), exponential(0.05, 2, 10), exponential(0.05, 2, 9)
PEER_COUNTS = [0.0, 1.0, 2.0, 3.0, 5.0, 8.0, 13.0, 21.0, 34.0, 55.0, 89.0, 144.0, 233.0]


#: The collectors by kind, with their labels; of histograms also the bounds.
COUNTERS = {
    "dht_discovery_queue_dropped_total": (), "discovery_work_items_total": ("result",), "crawler_queries_total": ("type", "mode", "worker"), "dht_messages_in_total": ("type",), "dht_packets_in_total": (), "dht_packets_out_total": (),
    "dht_packets_out_dropped_total": (), "dht_packets_in_dropped_total": (), "dht_nodes_discovered_total": ("result",), "indexer_peers_processed_total": ("result",), "indexer_metadata_fetched_total": (), "indexer_metadata_failed_total": ("reason",),
    "indexer_db_upserts_total": (), "torrents_indexed_total": ("type",), "scrape_cycles_total": (), "scrape_torrents_updated_total": (), "scrape_dead_detected_total": (), "scrape_errors_total": (), "scrape_history_pruned_total": (),
    "torznab_requests_total": (), "metadata_fetch_attempts_total": (), "metadata_fetch_success_total": (), "metadata_fetch_failed_total": ("reason",), "torrents_rejected_total": ("reason",), "indexer_db_errors_total": ("operation",), "crawler_samples_total": ("result",),
}
GAUGES = {
    "dht_discovery_queue_depth": (), "dht_queue_capacity": (), "crawler_traversal_queue_size": ("worker",), "crawler_cooldowns_active": ("worker",), "dht_routing_table_size": (), "indexer_workers_active": (), "torrents_total": ("state",),
    "discovered_channel_depth": (), "discovery_workers_busy": (), "indexer_workers_busy": (),
}
HISTOGRAMS = {
    "discovery_duration_seconds": ((), LOOKUPS), "indexer_fetch_duration_seconds": ((), FETCHES), "scrape_duration_seconds": ((), SUB_SECOND), "torznab_request_duration_seconds": ((), SUB_SECOND), "metadata_fetch_duration_seconds": ((), FETCHES),
    "indexer_db_query_duration_seconds": (("operation",), SUB_SECOND), "indexer_rate_limiter_wait_seconds": ((), SUB_SECOND), "indexer_peers_per_infohash": ((), PEER_COUNTS),
}


def collect(observations: DataFrame) -> DataFrame:
    """``name, labels, le, value`` of all collectors from a log of ``name, labels (map), value, at``.

    Counters are sums, gauges the latest value, histograms cumulative counts by bound with
    ``sum`` and ``count`` rows; names that are no collector's are left out.
    """
    key = F.array_join(F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    rows = observations.select("name", F.coalesce(key, F.lit("")).alias("labels"), "value", "at")
    none = F.lit(None).cast("string")
    sums = rows.where(F.col("name").isin(*COUNTERS)).groupBy("name", "labels").agg(F.sum("value").alias("value")).select("name", "labels", none.alias("le"), "value")
    last = gauge(rows.where(F.col("name").isin(*GAUGES)), "value", "at", "name", "labels").select("name", "labels", none.alias("le"), "value")
    bounds = F.coalesce(*(F.when(F.col("name") == k, F.array(*map(F.lit, v[1]))) for k, v in HISTOGRAMS.items()))
    held = rows.where(F.col("name").isin(*HISTOGRAMS)).select("name", "labels", "value", F.explode(F.concat(bounds, F.array(F.lit(float("inf"))))).alias("bound"))
    cells = held.groupBy("name", "labels", "bound").agg(F.count_if(F.col("value") <= F.col("bound")).cast("double").alias("value")).select("name", "labels", F.when(F.col("bound") == float("inf"), "+Inf").otherwise(F.col("bound").cast("string")).alias("le"), "value")
    totals = rows.where(F.col("name").isin(*HISTOGRAMS)).groupBy("name", "labels").agg(F.sum("value").alias("sum"), F.count("*").cast("double").alias("count"))
    ends = totals.select("name", "labels", F.explode(F.create_map(F.lit("sum"), F.col("sum"), F.lit("count"), F.col("count"))).alias("le", "value"))
    return sums.unionByName(last).unionByName(cells).unionByName(ends)


def counter(df: DataFrame, *labels: str) -> DataFrame:
    return df.groupBy(*labels).agg(F.count("*").alias("n"))


def gauge(df: DataFrame, value: str, ts: str, *labels: str) -> DataFrame:
    """The latest value; of equal times the largest."""
    return df.groupBy(*labels).agg(F.max(F.struct(ts, value)).alias("__v")).select(*labels, F.col(f"__v.{value}").alias("value"))


def histogram(df: DataFrame, value: str, bounds: list[float], *labels: str) -> DataFrame:
    """``le, n`` (cumulative, infinity last), with the sum and count of all, in one pass."""
    aggs = [F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)]
    got = df.groupBy(*labels).agg(*aggs, F.count(value).alias("total"), F.sum(value).alias("sum"))
    cells = [F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)] + [F.struct(F.lit(float("inf")).alias("le"), F.col("total").alias("n"))]
    return got.select(*labels, F.explode(F.array(*cells)).alias("c"), "sum", "total").select(*labels, "c.le", "c.n", "sum", "total")


def queue_outcomes(events: DataFrame) -> DataFrame:
    """``new, dropped, duplicate, duplicate_exact``: new ones count those dropped later, so the third is low by these."""
    got = events.agg(F.count("*").alias("total"), F.count_if(F.col("outcome").isin("new", "dropped")).alias("new"), F.count_if(F.col("outcome") == "dropped").alias("dropped"))
    return got.select("new", "dropped", (F.col("total") - F.col("new") - F.col("dropped")).alias("duplicate"), (F.col("total") - F.col("new")).alias("duplicate_exact"))

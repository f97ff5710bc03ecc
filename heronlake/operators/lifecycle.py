"""Popularity refresh: which tracker answers, what a refresh changes, and when the next is due."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heronlake.operators import catalog, dml

#: Seeders from which the next refresh comes after so many hours; fewer than all of these: after a week.
DELAYS = ((101, 1), (10, 6), (1, 24))
LAST_DELAY, BATCH = 168, 74


def next_delay_hours(seeders: Column) -> Column:
    out = F.lit(LAST_DELAY)
    for least, hours in reversed(DELAYS):
        out = F.when(seeders >= least, hours).otherwise(out)
    return out


def next_scrape(seeders: Column, now: Column) -> Column:
    return now + F.make_dt_interval(hours=next_delay_hours(seeders))


def state_after(state: Column, seeders: Column) -> Column:
    return F.when((seeders > 0) & state.isin("classified", "enriched"), "active").otherwise(state)


def batches(due: DataFrame, size: int = BATCH) -> DataFrame:
    """Packets of at most ``size`` keys, in key order within the (bounded) due list."""
    from pyspark.sql import Window

    return due.withColumn("batch", F.ceil(F.row_number().over(Window.orderBy("infohash")) / size).cast("int"))


def choose_tracker(results: DataFrame, order: str = "tracker_order") -> DataFrame:
    """The first tracker in order with any seeder for the batch, else the last that answered; its results."""
    heard = results.groupBy("tracker_id", order).agg(F.bool_or(F.col("seeders") > 0).alias("any"))
    pick = heard.agg(F.min_by("tracker_id", F.when(F.col("any"), F.col(order))).alias("first"), F.max_by("tracker_id", order).alias("last")).select(F.coalesce("first", "last").alias("tracker_id"))
    return results.join(F.broadcast(pick), "tracker_id", "left_semi")  # one row


def apply_scrape(torrents: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """Torrents after a refresh (``results``: ``infohash, seeders, leechers``, one row a key); ``last_seen`` moves only with seeders."""
    new = results.select("infohash", F.struct("seeders", "leechers").alias("__new"))
    hit, s = F.col("__new").isNotNull(), F.col("__new.seeders")
    return torrents.join(new, "infohash", "left").withColumns({
        "state": F.when(hit, state_after(F.col("state"), s)).otherwise(F.col("state")), "scrape_at": F.when(hit, next_scrape(s, now)).otherwise(F.col("scrape_at")),
        "last_seen": F.when(hit & (s > 0), now).otherwise(F.col("last_seen")), "seeders": F.when(hit, s).otherwise(F.col("seeders")), "leechers": F.when(hit, F.col("__new.leechers")).otherwise(F.col("leechers")),
    }).select(*torrents.columns)


def refresh(torrents: DataFrame, results: DataFrame, tracker_id: int, now: Column) -> dict[str, DataFrame]:
    """All that a refresh writes: the torrents, and new rows of history and links; only known torrents count, and the tracker is the first one configured."""
    known = results.join(torrents.select("infohash"), "infohash", "left_semi")
    history = known.select("infohash", F.lit(tracker_id).cast("long").alias("tracker_id"), now.alias("scraped_at"), "seeders", "leechers")
    return {"torrents": apply_scrape(torrents, known, now), "scrape_history": history, "torrent_trackers": history.select("infohash", "tracker_id", F.col("scraped_at").alias("last_scrape"))}


def sweep_dead(torrents: DataFrame, now: Column, days: int = 90, most: int = 1000) -> DataFrame:
    """Torrents with the longest-unseen candidates marked dead, at most so many a run."""
    return dml.mark_dead(torrents, catalog.dead_candidates(torrents, now - F.make_dt_interval(days=F.lit(days)), most))


def prune(history: DataFrame, now: Column, days: int = 90) -> DataFrame:
    return dml.prune_history(history, now - F.make_dt_interval(days=F.lit(days)))


def first_metadata(results: DataFrame, most_peers: int) -> DataFrame:
    """The first success among each key's first peers: ``infohash, ok, seq, peer_rank`` and what was fetched."""
    rows = results.where(F.col("ok") & (F.col("peer_rank") < most_peers))
    return rows.groupBy("infohash").agg(F.min_by(F.struct(*[c for c in results.columns if c != "infohash"]), "seq").alias("r")).select("infohash", "r.*")

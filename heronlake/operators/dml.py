"""Writes as new versions of a table: each function gives the table's rows after the statement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heronlake.functions.classify import extension, is_video
from heronlake.schemas import DEPENDENTS, STATES


def new_rows(arrivals: DataFrame, table: DataFrame, key: str = "infohash", order: str | None = None) -> DataFrame:
    """The first arrival of each key that the table lacks."""
    first = arrivals.groupBy(key).agg(F.min_by(F.struct(*arrivals.columns), order or key).alias("r")).select("r.*") if order else arrivals.dropDuplicates([key])
    return first.join(table.select(key), key, "left_anti")


def insert_new(arrivals: DataFrame, table: DataFrame, key: str = "infohash", order: str | None = None) -> DataFrame:
    return table.unionByName(new_rows(arrivals.select(*table.columns), table, key, order))


def explode_files(rows: DataFrame) -> DataFrame:
    """From parallel arrays ``paths``, ``sizes``: a row a file, '' extension as null; ``is_video`` by the extension as written."""
    ext = extension(F.col("path"))
    pairs = rows.select("infohash", F.inline(F.arrays_zip(F.col("paths").alias("path"), F.col("sizes").alias("size"))))
    return pairs.toDF("infohash", "path", "size").select("infohash", "path", "size", F.nullif(ext, F.lit("")).alias("extension"), is_video(ext).alias("is_video"))


def overwrite(table: DataFrame, changes: DataFrame, columns: list[str], key: str = "infohash", touched: Column | None = None) -> DataFrame:
    """Columns of the rows that ``changes`` (one row a key) names; ``touched`` goes to updated_at."""
    new = changes.select(key, F.struct(*columns).alias("__new"))
    hit = F.col("__new").isNotNull()
    out = [F.when(hit, F.col(f"__new.{c}")).otherwise(F.col(c)).alias(c) if c in columns else (F.when(hit, touched).otherwise(F.col(c)).alias(c) if c == "updated_at" and touched is not None else F.col(c)) for c in table.columns]
    return table.join(new, key, "left").select(*out)


def set_state(torrents: DataFrame, infohash: str, state: str) -> DataFrame:
    if state not in STATES:
        raise ValueError(f"state is one of {', '.join(STATES)}")
    return torrents.withColumn("state", F.when(F.col("infohash") == infohash, state).otherwise(F.col("state")))


def mark_dead(torrents: DataFrame, keys: DataFrame) -> DataFrame:
    marked = keys.select("infohash").distinct().withColumn("__dead", F.lit(True))
    return torrents.join(marked, "infohash", "left").withColumn("state", F.when(F.col("__dead"), "dead").otherwise(F.col("state"))).select(*torrents.columns)


def delete_cascade(tables: dict[str, DataFrame], keys: DataFrame) -> dict[str, DataFrame]:
    """``tables`` without the torrents of ``keys`` and all that depends on them."""
    return {t: df.join(keys.select("infohash").distinct(), "infohash", "left_anti") if t in ("torrents", *DEPENDENTS) else df for t, df in tables.items()}


def upsert_trackers(table: DataFrame, urls: DataFrame, now: Column) -> DataFrame:
    """Known urls are touched; new ones get ids by a hash, which stays the same."""
    asked = urls.select("url").distinct().withColumn("__asked", F.lit(True))
    kept = table.join(asked, "url", "left").withColumn("updated_at", F.when(F.col("__asked"), now).otherwise(F.col("updated_at"))).select(*table.columns)
    new = asked.join(table, "url", "left_anti").select(F.xxhash64("url").alias("id"), "url", now.alias("created_at"), now.alias("updated_at"))
    return kept.unionByName(new.select(*table.columns))


def upsert_links(table: DataFrame, seen: DataFrame) -> DataFrame:
    """``infohash, tracker_id, last_scrape``: the latest wins; ``is_active`` stays, true for new rows."""
    rows = table.select("infohash", "tracker_id", "last_scrape", "is_active").unionByName(seen.select("infohash", "tracker_id", "last_scrape", F.lit(None).cast("boolean").alias("is_active")))
    return rows.groupBy("infohash", "tracker_id").agg(F.max("last_scrape").alias("last_scrape"), F.coalesce(F.min("is_active"), F.lit(True)).alias("is_active"))


def prune_history(history: DataFrame, cutoff: Column) -> DataFrame:
    return history.where(~F.coalesce(F.col("scraped_at") < cutoff, F.lit(False)))

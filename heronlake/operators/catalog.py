"""Catalogue reads. Orders end in the key, so that pages are stable; a parameter of None puts no filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heronlake.functions import fts

DEFAULT_LIMIT = 100


def optional(column: str, value) -> Column:
    """Equality, or nothing for None."""
    return F.lit(True) if value is None else F.col(column) == value


def page(df: DataFrame, limit: int | None, offset: int = 0) -> DataFrame:
    limit = DEFAULT_LIMIT if not limit or limit <= 0 else limit
    return (df.offset(offset) if offset > 0 else df).limit(limit)


def by_seeders(df: DataFrame) -> DataFrame:
    return df.orderBy(F.col("seeders").desc(), "infohash")


def _active(torrents: DataFrame, q: str | None, words: DataFrame | None = None) -> DataFrame:
    """Active rows with all words of the query by their English stems; ``words`` (:func:`heronlake.functions.fts.stems`) is a kept inverted table."""
    rows = torrents.where(F.col("state") == "active")
    return rows if q is None else fts.search_stemmed(rows, q, words=words)


def search_all(torrents: DataFrame, q: str | None = None, limit: int | None = None, offset: int = 0, words: DataFrame | None = None) -> DataFrame:
    return page(by_seeders(_active(torrents, q, words)), limit, offset)


def search_movies(torrents: DataFrame, movies: DataFrame, q: str | None = None, limit: int | None = None, offset: int = 0, words: DataFrame | None = None) -> DataFrame:
    return page(by_seeders(_active(torrents, q, words).join(movies, "infohash")), limit, offset)


def movies_by_imdb(torrents: DataFrame, movies: DataFrame, imdb_id: str) -> DataFrame:
    return by_seeders(_active(torrents, None).join(movies.where(F.col("imdb_id") == imdb_id), "infohash"))


def search_tv(torrents: DataFrame, tv: DataFrame, q: str | None = None, season: int | None = None, episode: int | None = None, limit: int | None = None, offset: int = 0, words: DataFrame | None = None) -> DataFrame:
    shows = tv.where(optional("season", season)).where(optional("episode", episode))
    return page(by_seeders(_active(torrents, q, words).join(shows, "infohash")), limit, offset)


def tv_by_imdb(torrents: DataFrame, tv: DataFrame, imdb_id: str, season: int | None = None, episode: int | None = None) -> DataFrame:
    shows = tv.where(F.col("imdb_id") == imdb_id).where(optional("season", season)).where(optional("episode", episode))
    return by_seeders(_active(torrents, None).join(shows, "infohash"))


def get(torrents: DataFrame, infohash: str) -> DataFrame:
    return torrents.where(F.col("infohash") == infohash)


def list_torrents(torrents: DataFrame, state: str | None = None, content_type: str | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    rows = torrents.where(optional("state", state)).where(optional("content_type", content_type))
    return page(rows.orderBy(F.col("created_at").desc(), "infohash"), limit, offset)


def count(torrents: DataFrame) -> DataFrame:
    return torrents.agg(F.count("*").alias("n"))


def count_by_state(torrents: DataFrame) -> DataFrame:
    return torrents.groupBy("state").agg(F.count("*").alias("n"))


def with_files(torrents: DataFrame, files: DataFrame) -> DataFrame:
    """Each torrent with its files, all in one join."""
    lists = files.groupBy("infohash").agg(F.sort_array(F.collect_list(F.struct("path", "size"))).alias("files"))
    return torrents.join(lists, "infohash", "left")


def file_stats(files: DataFrame) -> DataFrame:
    """Per torrent: files, their size, video files as classified and as flagged, by extension."""
    from heronlake.functions.classify import extension, is_video

    ext = extension(F.col("path"))
    return files.groupBy("infohash").agg(F.count("*").alias("n_files"), F.sum("size").alias("total_size"), F.count_if(is_video(F.lower(ext))).alias("n_video"), F.count_if(is_video(ext)).alias("n_flagged"))


def due(torrents: DataFrame, now: Column, limit: int) -> DataFrame:
    """What to refresh next, never refreshed first."""
    rows = torrents.where((F.col("scrape_at").isNull() | (F.col("scrape_at") < now)) & F.col("state").isin("classified", "enriched", "active"))
    return rows.orderBy(F.col("scrape_at").asc_nulls_first(), "infohash").limit(limit)


def dead_candidates(torrents: DataFrame, cutoff: Column, limit: int = 1000) -> DataFrame:
    seen = F.coalesce("last_seen", "first_seen")
    rows = torrents.where((F.col("seeders") == 0) & F.col("scrape_at").isNotNull() & ~F.col("state").isin("dead", "rejected") & (seen < cutoff))
    return rows.orderBy(seen, "infohash").limit(limit)


def name_contains(rows: DataFrame, part: str) -> DataFrame:
    """Of a page already fetched."""
    return rows.where(F.contains(F.lower("name"), F.lit(part.lower())))

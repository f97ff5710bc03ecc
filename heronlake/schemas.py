"""Catalogue tables: schemas, domains, defaults and checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Domains in their order.
STATES = ("pending", "classified", "enriched", "active", "dead", "rejected")
CONTENT_TYPES = ("movie", "tv", "unknown", "anime")
GENRE_KINDS = ("movie", "tv")


_TYPES = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "date": T.DateType()}


def _schema(columns: str) -> T.StructType:
    """From names with types; needs no session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in map(str.split, columns.split(", "))])


SCHEMAS = {
    "torrents": _schema(
        "infohash string, name string, total_size long, file_count long, state string, content_type string, quality string, encoding string, dynamic_range string, "
        "source string, release_group string, scene_name string, classified_title string, classified_year int, classified_season int, classified_episode int, "
        "seeders long, leechers long, scrape_at timestamp, enrichment_attempts int, enrichment_last_attempted_at timestamp, first_seen timestamp, last_seen timestamp, created_at timestamp, updated_at timestamp"
    ),
    "torrent_files": _schema("id long, infohash string, path string, size long, extension string, is_video boolean, created_at timestamp, updated_at timestamp"),
    "trackers": _schema("id long, url string, created_at timestamp, updated_at timestamp"),
    "torrent_trackers": _schema("infohash string, tracker_id long, last_scrape timestamp, is_active boolean"),
    "scrape_history": _schema("id long, infohash string, tracker_id long, scraped_at timestamp, seeders long, leechers long"),
    "genres": _schema("id long, tmdb_id long, kind string, name string"),
    "tmdb_movies": _schema("infohash string, tmdb_id long, imdb_id string, title string, original_title string, year int, overview string, runtime int, language string, popularity double, vote_average double, poster string, backdrop string, match_confidence double"),
    "tmdb_movie_genres": _schema("infohash string, genre_id long"),
    "tmdb_tv": _schema("infohash string, tmdb_id long, imdb_id string, series_name string, season int, episode int, episode_name string, overview string, first_air_date date, match_confidence double"),
    "tmdb_tv_genres": _schema("infohash string, genre_id long"),
}
KEYS = {
    "torrents": ("infohash",), "torrent_files": ("id",), "trackers": ("url",), "torrent_trackers": ("infohash", "tracker_id"), "scrape_history": ("id",), "genres": ("tmdb_id", "kind"),
    "tmdb_movies": ("infohash",), "tmdb_movie_genres": ("infohash", "genre_id"), "tmdb_tv": ("infohash",), "tmdb_tv_genres": ("infohash", "genre_id"),
}
#: Tables whose rows go with their torrent.
DEPENDENTS = ("torrent_files", "torrent_trackers", "scrape_history", "tmdb_movies", "tmdb_movie_genres", "tmdb_tv", "tmdb_tv_genres")


def with_defaults(torrents: DataFrame, now: Column) -> DataFrame:
    """Missing or null columns of ``torrents`` as a new row would have them, in table order."""
    given = {"state": F.lit("pending"), "content_type": F.lit("unknown"), "seeders": F.lit(0), "leechers": F.lit(0), "enrichment_attempts": F.lit(0), "total_size": F.lit(0), "file_count": F.lit(0), "first_seen": now, "created_at": now, "updated_at": now}
    out = []
    for f in SCHEMAS["torrents"].fields:
        c = F.col(f.name) if f.name in torrents.columns else F.lit(None)
        out.append((F.coalesce(c, given[f.name]) if f.name in given else c).cast(f.dataType).alias(f.name))
    return torrents.select(*out)


def rules(table: str) -> dict[str, Column]:
    """What each row must satisfy, by name; null passes as in SQL checks, but for the required columns."""
    c = F.col
    named: dict[str, dict[str, Column]] = {
        "torrents": {
            "infohash_required": c("infohash").isNotNull(), "first_seen_required": c("first_seen").isNotNull(), "name_length": F.length("name") <= 500, "total_size_sign": c("total_size") >= 0, "file_count_sign": c("file_count") >= 0,
            "seeders_sign": c("seeders") >= 0, "leechers_sign": c("leechers") >= 0, "state_domain": c("state").isin(*STATES), "content_type_domain": c("content_type").isin(*CONTENT_TYPES),
        },
        "torrent_files": {"size_sign": c("size") >= 0},
        "scrape_history": {"seeders_sign": c("seeders") >= 0, "leechers_sign": c("leechers") >= 0},
        "genres": {"kind_domain": c("kind").isin(*GENRE_KINDS)},
        "tmdb_movies": {"runtime_sign": c("runtime") > 0, "confidence_range": c("match_confidence").between(0, 1)},
        "tmdb_tv": {"season_sign": c("season") > 0, "episode_sign": c("episode") > 0, "confidence_range": c("match_confidence").between(0, 1)},
    }
    return named.get(table, {})


def violations(df: DataFrame, table: str) -> DataFrame:
    """``rule, n``: each check with the rows that break it, in one pass, and repeated keys under ``key_unique``."""
    checks = {k: v for k, v in rules(table).items() if all(x in df.columns for x in _columns(k, table))}
    parts = []
    if checks:
        counts = df.agg(*(F.count_if(~F.coalesce(v, F.lit(True))).alias(k) for k, v in checks.items()))
        parts.append(counts.select(F.explode(F.array(*(F.struct(F.lit(k).alias("rule"), F.col(k).alias("n")) for k in checks))).alias("x")).select("x.*"))
    if all(k in df.columns for k in KEYS[table]):
        again = df.groupBy(*KEYS[table]).agg(F.count("*").alias("n")).where("n > 1")
        parts.append(again.agg(F.count("*").alias("n")).select(F.lit("key_unique").alias("rule"), "n"))
    return reduce(DataFrame.union, parts)


def _columns(rule: str, table: str) -> list[str]:
    stem = {"name_length": "name", "confidence_range": "match_confidence", "infohash_required": "infohash", "first_seen_required": "first_seen"}.get(rule)
    return [stem or rule.rsplit("_", 1)[0]]

"""The catalogue's tables as projections of the TPC-H-like driver tables.

Each view is Spark SQL text over temporary names; :func:`views` registers nothing and
returns DataFrames. ``SQL`` holds the same projections for other engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from heronlake.session import read_spread

_HASH = "sha1(concat('o', CAST({} AS VARCHAR(20))))"

#: Release names: a part's name, a season or year, tags and an ending, all by the order's number.
_NAME = """concat(replace(p.p_name, ' ', CASE o.o_orderkey%3 WHEN 0 THEN '.' WHEN 1 THEN '_' ELSE ' ' END),
 CASE o.o_orderkey%7 WHEN 0 THEN concat('.S0', CAST(1+o.o_orderkey%9 AS VARCHAR(9)), 'E', CAST(10+o.o_orderkey%80 AS VARCHAR(9)))
  WHEN 1 THEN concat('.', CAST(1+o.o_orderkey%9 AS VARCHAR(9)), 'x', CAST(10+o.o_orderkey%80 AS VARCHAR(9)))
  WHEN 2 THEN concat('.Season.', CAST(1+o.o_orderkey%9 AS VARCHAR(9))) WHEN 3 THEN '' ELSE concat('.', CAST(1960+o.o_orderkey%70 AS VARCHAR(9))) END,
 CASE o.o_orderkey%5 WHEN 0 THEN '.1080p' WHEN 1 THEN '.720p' WHEN 2 THEN '.2160p' WHEN 3 THEN '.4K.UHD' ELSE '' END,
 CASE o.o_orderkey%4 WHEN 0 THEN '.BluRay' WHEN 1 THEN '.WEB-DL' WHEN 2 THEN '.HDTV' ELSE '' END,
 CASE o.o_orderkey%6 WHEN 0 THEN '.x264' WHEN 1 THEN '.HEVC' WHEN 2 THEN '.H.264' WHEN 3 THEN '.AV1.HDR10+' ELSE '' END,
 CASE o.o_orderkey%8 WHEN 0 THEN '' WHEN 1 THEN '.mkv' ELSE '-GRP' END)"""

SQL = {
    "torrents": f"""SELECT {_HASH.format('o.o_orderkey')} AS infohash, {_NAME} AS name, CAST(round(o.o_totalprice*100) AS BIGINT)*1000 AS total_size,
 o.o_orderkey%150 AS seeders, o.o_orderkey%40 AS leechers,
 CASE CAST(floor(o.o_orderkey/4) AS BIGINT)%6 WHEN 0 THEN 'pending' WHEN 1 THEN 'classified' WHEN 2 THEN 'enriched' WHEN 3 THEN 'active' WHEN 4 THEN 'dead' ELSE 'rejected' END AS state,
 CASE o.o_orderkey%4 WHEN 0 THEN 'movie' WHEN 1 THEN 'tv' WHEN 2 THEN 'anime' ELSE 'unknown' END AS content_type,
 CASE o.o_orderkey%5 WHEN 0 THEN '1080p' WHEN 1 THEN '720p' WHEN 2 THEN '2160p' WHEN 3 THEN '4K' ELSE NULL END AS quality,
 o.o_orderdate AS first_seen, o.o_orderdate AS created_at,
 CASE WHEN o.o_orderkey%7=0 THEN NULL ELSE o.o_orderdate END AS scrape_at,
 CASE WHEN o.o_orderkey%11=0 THEN NULL ELSE o.o_orderdate END AS last_seen
FROM {{orders}} o JOIN {{part}} p ON p.p_partkey = o.o_orderkey%200""",
    # Names of the kinds that the others lack: groups and sites in brackets, running episode numbers, streaming services, words that are refused, sizes beyond the limits.
    "releases": f"""SELECT {_HASH.format('o_orderkey')} AS infohash, CASE o_orderkey%12 WHEN 0 THEN concat('[SubsPlease] ', p_name, ' - ', CAST(10+o_orderkey%80 AS VARCHAR(9)), ' (1080p)')
  WHEN 1 THEN concat('www.site', CAST(o_orderkey%30 AS VARCHAR(9)), '.org - ', replace(p_name, ' ', '.'), '.2019.720p.HDTV') WHEN 2 THEN concat(replace(p_name, ' ', '.'), '.EP', CAST(100+o_orderkey%900 AS VARCHAR(9)), '.576p.XviD')
  WHEN 3 THEN concat(replace(p_name, ' ', '_'), '_S01E', CAST(10+o_orderkey%80 AS VARCHAR(9)), '_Crunchyroll_WEBRip') WHEN 4 THEN concat('[Erai-raws] ', p_name, ' [', CAST(o_orderkey%99 AS VARCHAR(9)), '][HEVC]')
  WHEN 5 THEN concat(replace(p_name, ' ', '.'), '.XXX.2011.1080p') WHEN 6 THEN concat(p_name, ' x64 Multilingual 2012 720p') WHEN 7 THEN concat(replace(p_name, ' ', '.'), '.2001.Dolby.Vision.2160p.REMUX-AB')
  WHEN 8 THEN concat(p_name, ' 2001 SDR 480p DVDRip DivX.avi') WHEN 9 THEN concat(p_name, '.1999.DV.Blu-Ray-GROUP.mkv') WHEN 10 THEN concat('[site.com] [Judas] ', p_name, ' 123-140 (BD 720p)')
  ELSE concat(p_name, ' S3 - ', CAST(o_orderkey%1000 AS VARCHAR(9)), ' PDTV x265') END AS name,
 CASE CAST(floor(o_orderkey/16) AS BIGINT)%9 WHEN 0 THEN 1000 WHEN 1 THEN 214748364800 ELSE 2147483648 END AS total_size, 'pending' AS state, 'unknown' AS content_type
FROM {{orders}} JOIN {{part}} ON p_partkey = o_orderkey%200""",
    "torrent_files": f"""SELECT {_HASH.format('l_orderkey')} AS infohash,
 concat('dir.', CAST(l_suppkey AS VARCHAR(20)), '/f', CAST(l_linenumber AS VARCHAR(9)), CASE l_partkey%6 WHEN 0 THEN '.mkv' WHEN 1 THEN '.MKV' WHEN 2 THEN '.srt' WHEN 3 THEN '.exe' WHEN 4 THEN '' ELSE '.mp4' END) AS path,
 CAST(l_quantity AS BIGINT)*1048576 AS size FROM {{lineitem}}""",
    "scrape_history": f"""SELECT {_HASH.format('l_orderkey')} AS infohash, l_suppkey AS tracker_id, l_shipdate AS scraped_at, CAST(l_quantity AS BIGINT) AS seeders, CAST(l_linenumber AS BIGINT) AS leechers FROM {{lineitem}}""",
    "tmdb_movies": f"""SELECT {_HASH.format('o_orderkey')} AS infohash, p_partkey AS tmdb_id, concat('tt', CAST(1000000+p_partkey AS VARCHAR(20))) AS imdb_id, p_name AS title, 1960+p_size AS year
FROM {{orders}} JOIN {{part}} ON p_partkey = o_orderkey%200 WHERE o_orderkey%4 = 0""",
    "tmdb_tv": f"""SELECT {_HASH.format('o_orderkey')} AS infohash, p_partkey AS tmdb_id, concat('tt', CAST(2000000+p_partkey AS VARCHAR(20))) AS imdb_id, p_name AS series_name,
 CAST(1+o_orderkey%9 AS INT) AS season, CASE WHEN o_orderkey%13 = 0 THEN NULL ELSE CAST(10+o_orderkey%80 AS INT) END AS episode
FROM {{orders}} JOIN {{part}} ON p_partkey = o_orderkey%200 WHERE o_orderkey%4 = 1""",
    "discovered": """SELECT event_id, sha1(concat('u', CAST(user_id AS VARCHAR(20)))) AS infohash,
 concat('10.', CAST(event_id%256 AS VARCHAR(9)), '.', CAST((event_id*7)%256 AS VARCHAR(9)), '.', CAST((event_id*13)%256 AS VARCHAR(9))) AS ip, 1024+event_id%60000 AS port, ts AS seen_at FROM {events}""",
    "nodes": """SELECT sha1(concat('n', CAST(c_custkey AS VARCHAR(20)))) AS node_id, c_custkey, c_custkey%4 AS failure_count FROM {customer}""",
    "trackers": """SELECT s_suppkey AS id, CASE s_suppkey%4 WHEN 0 THEN concat('http://t', CAST(s_suppkey AS VARCHAR(20)), '.example/announce') WHEN 1 THEN concat('udp://t', CAST(s_suppkey AS VARCHAR(20)), '.example:6969/announce')
 WHEN 2 THEN concat('udp://u', CAST(s_suppkey AS VARCHAR(20)), '.example:80') ELSE 'not a url' END AS url FROM {supplier}""",
    "scrape_results": f"""SELECT l_suppkey AS tracker_id, {_HASH.format('l_orderkey')} AS infohash, max(CASE WHEN l_suppkey%3 = 0 THEN 0 ELSE CAST(l_quantity AS BIGINT)%120 END) AS seeders, max(CAST(l_linenumber AS BIGINT)) AS leechers
FROM {{lineitem}} GROUP BY l_suppkey, l_orderkey""",
    "fetch_results": """SELECT event_id AS seq, sha1(concat('x', CAST(event_id%700 AS VARCHAR(20)))) AS infohash, event_id%40 AS peer_rank, event_type <> 'error' AS ok,
 CASE WHEN event_id%97 = 0 THEN concat('pthc set ', CAST(event_id AS VARCHAR(20))) WHEN event_id%5 = 0 THEN concat('Show.Name.S0', CAST(1+event_id%9 AS VARCHAR(9)), 'E', CAST(10+event_id%80 AS VARCHAR(9)), '.1080p.WEB-DL-GRP') ELSE concat('Some.Film.', CAST(1960+event_id%60 AS VARCHAR(9)), '.720p.BluRay.x264-GRP') END AS name,
 CAST(round(value*1000) AS BIGINT)*10000 AS total_size, ts AS seen_at FROM {events}""",
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str, heavy: bool = False) -> DataFrame:
    """One of the views above, for ``heavy`` work a row or not; timestamps become instants (UTC sessions are expected)."""
    text = SQL[name]
    read = (lambda t: read_spread(spark, f"{sf_dir}/{t}.parquet")) if heavy else (lambda t: table(spark, sf_dir, t))
    used = {t: read(t) for t in TABLES if "{" + t + "}" in text}
    df = spark.sql(text, **used)
    return df.select(*(df[f.name].cast("timestamp").alias(f.name) if f.dataType.simpleString() == "timestamp_ntz" else df[f.name] for f in df.schema.fields))


def cte(*names: str) -> str:
    """``WITH`` clause with these views, for oracle SQL on the driver's tables."""
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n].format(**{t: t for t in TABLES})})" for n in names)

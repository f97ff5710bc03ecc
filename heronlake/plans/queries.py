"""Queries over the driver's tables, each with the SQL it must equal where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heronlake.functions import classify as C
from heronlake.functions import fts, ids, text
from heronlake.functions import patterns as P
from heronlake.operators import catalog, dml, lifecycle, metrics, routing, serve
from heronlake.plans.fixtures import cte, view
from heronlake.schemas import violations
from heronlake.session import ship
from heronlake.sources import messages, scrape
from heronlake.streaming import ingest, state

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
NOW = "1999-01-01 00:00:00"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str, f: Query = f) -> DataFrame:
            return f(ship(spark), sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def when(c: str) -> Column:
    """A time as text, the same in all engines."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


def sql_when(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c.rpartition('.')[2]}"


# --- classifier -------------------------------------------------------------
def _m(s: str, p: str) -> str:
    return f"regexp_matches({s}, '{p}')"


def _x(s: str, p: str, g: int = 0) -> str:
    return f"regexp_extract({s}, '{p}', {g})"


_NORM = r"trim(regexp_replace(translate({}, '._', '  '), '\s+', ' ', 'g'))"
_TRIM = r"regexp_replace(trim({}), '[ \-–_.(\[]+$', '')"
_VIDEO = "(" + ", ".join(f"'{e}'" for e in P.VIDEO_EXTENSIONS) + ")"
_EXT = r"regexp_extract({}, '(\.[^./]*)$', 1)"
_EP = "coalesce({}, '0')::INT"
_GROUPS = lambda *gs: _EP.format("coalesce(" + ", ".join(f"nullif({_x('n', P.EPISODE, g)}, '')" for g in gs) + ", NULL)")
_CLASSIFIED = f"""
norm AS (SELECT *, regexp_replace({_NORM.format('name')}, '{P.SITE_PREFIX}', '') AS n FROM torrents),
tv AS (SELECT *, {_m('n', P.EPISODE)} OR {_m('n', P.SEASON_PACK)} AS is_tv,
  CASE WHEN {_m('n', P.EPISODE)} THEN {_GROUPS(1, 3, 6)} WHEN {_m('n', P.SEASON_PACK)} THEN coalesce(nullif({_x('n', P.SEASON, 1)}, ''), '0')::INT ELSE 0 END AS s,
  CASE WHEN {_m('n', P.EPISODE)} THEN {_GROUPS(2, 4, 5, 7, 8)} ELSE 0 END AS e,
  {_m('name', P.ADULT)} OR {_m('n', P.ADULT)} AS adult, {_m('name', P.SOFTWARE)} OR {_m('n', P.SOFTWARE)} AS software,
  coalesce(nullif({_x('n', P.YEAR, 1)}, ''), '0')::INT AS year, {_x('n', P.RESOLUTION)} AS res,
  regexp_replace(n, '{P.CODEC_TOKEN}', '', 'g') AS plain, regexp_replace(name, '{P.BRACKET_SITE}', '') AS bare FROM norm),
kind AS (SELECT *, NOT adult AND ({_m('plain', P.EP_NUMBER)} OR ({_m('bare', P.BRACKET_PREFIX)} AND ({_m('plain', P.BARE_EPISODE)} OR {_m('bare', P.BRACKET_EPISODE)}))
   OR (is_tv AND ({_m('name', P.FANSUB)} OR {_m('n', P.STREAMING)}))) AS anime FROM tv),
classified AS (SELECT infohash, name, state AS old_state, content_type AS old_type, total_size, adult, software,
  CASE WHEN anime THEN 'anime' WHEN is_tv THEN 'tv' WHEN year > 0 OR res <> '' THEN 'movie' ELSE 'unknown' END AS content_type,
  CASE WHEN anime THEN {_TRIM.format(f"{_x('u', P.ANIME_TITLE, 1)}")} ELSE {_TRIM.format(f"{_x('n', P.TITLE, 1)}")} END AS title,
  year, CASE WHEN anime OR is_tv THEN s ELSE 0 END AS season, CASE WHEN anime OR is_tv THEN e ELSE 0 END AS episode, res AS quality, {_x('n', P.ENCODING)} AS encoding, {_x('n', P.DYNAMIC_RANGE)} AS dynamic_range, {_x('n', P.SOURCE)} AS source,
  {_x(f"CASE WHEN lower({_EXT.format('name')}) IN {_VIDEO} THEN regexp_replace(name, '{chr(92)}.[^./]*$', '') ELSE name END", P.RELEASE_GROUP, 1)} AS release_group
  FROM (SELECT *, regexp_replace(n, '{P.BRACKET_PREFIX}', '') AS u FROM kind))"""
_ALLOWED = "(" + ", ".join(f"'{e}'" for e in (*P.VIDEO_EXTENSIONS, *C.ALLOWED)) + ")"
_FILES = f"""
counts AS (SELECT infohash, count(*) AS n_files, count(*) FILTER (lower({_EXT.format('path')}) IN {_VIDEO}) AS n_video, count(*) FILTER (lower({_EXT.format('path')}) NOT IN {_ALLOWED}) AS n_bad FROM torrent_files GROUP BY infohash),
judged AS (SELECT c.*, CASE WHEN total_size < 52428800 OR total_size > 161061273600 THEN 'size' WHEN adult THEN 'adult' WHEN software THEN 'software' WHEN content_type = 'unknown' THEN 'unknown_type'
  WHEN n_files > 0 AND n_video = 0 THEN 'no_video' WHEN n_files > 0 AND n_bad > 0 THEN 'bad_extension' ELSE '' END AS reason
  FROM classified c LEFT JOIN counts USING (infohash))"""


@query(f"{cte('torrents')}, {_CLASSIFIED} SELECT infohash, content_type, title, year, quality, encoding, dynamic_range, source, release_group FROM classified")
def classify_names(spark, sf):
    return C.classify(view(spark, sf, "torrents", heavy=True)).select("infohash", *(f"result.{c}" for c in ("content_type", "title", "year", "quality", "encoding", "dynamic_range", "source", "release_group")))


@query(f"{cte('torrents')}, {_CLASSIFIED} SELECT infohash, season, episode FROM classified WHERE content_type IN ('tv', 'anime')")
def classify_tv_numbers(spark, sf):
    return C.classify(view(spark, sf, "torrents", heavy=True)).where(F.col("result.content_type").isin("tv", "anime")).select("infohash", "result.season", "result.episode")


@query(f"{cte('torrents')}, {_CLASSIFIED} SELECT title, content_type, count(*) AS n FROM classified GROUP BY ALL")
def classify_titles(spark, sf):
    return C.classify(view(spark, sf, "torrents", heavy=True)).groupBy("result.title", "result.content_type").agg(F.count("*").alias("n"))


@query(f"""{cte('releases', 'torrent_files')}, torrents AS (SELECT * FROM releases), {_CLASSIFIED}, {_FILES}
SELECT infohash, content_type, title, year, season, episode, quality, encoding, dynamic_range, source, release_group, reason AS rejection_reason FROM judged""")
def classify_releases(spark, sf):
    rows = catalog.with_files(view(spark, sf, "releases", heavy=True), view(spark, sf, "torrent_files"))
    fields = ("content_type", "title", "year", "season", "episode", "quality", "encoding", "dynamic_range", "source", "release_group", "rejection_reason")
    return C.classify(rows).select("infohash", *(f"result.{c}" for c in fields))


@query(f"{cte('torrents', 'torrent_files')}, {_CLASSIFIED}, {_FILES} SELECT infohash, reason AS rejection_reason, CASE WHEN reason = '' THEN 'classified' ELSE 'rejected' END AS state FROM judged")
def reject_cascade(spark, sf):
    rows = catalog.with_files(view(spark, sf, "torrents", heavy=True), view(spark, sf, "torrent_files"))
    return C.classify(rows).select("infohash", "result.rejection_reason", "result.state")


@query(f"""{cte('torrents', 'torrent_files')}, {_CLASSIFIED}, {_FILES}, moved AS (SELECT *, CASE WHEN old_state IN ('pending', 'rejected') THEN CASE WHEN reason = '' THEN 'classified' ELSE 'rejected' END ELSE old_state END AS new_state FROM judged)
SELECT infohash, old_type, old_state, content_type AS new_type, new_state, nullif(title, '') AS title, nullif(year, 0) AS year, nullif(season, 0) AS season FROM moved WHERE old_type <> content_type OR old_state <> new_state""")
def reclassify_diff(spark, sf):
    rows = C.reclassify(view(spark, sf, "torrents", heavy=True), view(spark, sf, "torrent_files"))
    return rows.select("infohash", "old_type", "old_state", "new_type", "new_state", F.col("set_classified_title").alias("title"), F.col("set_classified_year").alias("year"), F.col("set_classified_season").alias("season"))


@query(f"""{cte('torrents', 'torrent_files')}, {_CLASSIFIED}, {_FILES}, moved AS (SELECT *, CASE WHEN old_state IN ('pending', 'rejected') THEN CASE WHEN reason = '' THEN 'classified' ELSE 'rejected' END ELSE old_state END AS new_state FROM judged)
SELECT infohash || ' "' || name || '": content_type ' || old_type || '→' || content_type || ', state ' || old_state || '→' || new_state AS line FROM moved WHERE old_type <> content_type OR old_state <> new_state""")
def reclassify_lines(spark, sf):
    return C.diff_line(C.reclassify(view(spark, sf, "torrents", heavy=True), view(spark, sf, "torrent_files")))


@query(f"""{cte('fetch_results')} SELECT count(*) FILTER ({_m(_NORM.format('name'), P.BLOCKED)}) AS n_blocked, count(*) AS n FROM fetch_results""")
def safety_gate(spark, sf):
    return view(spark, sf, "fetch_results").agg(F.count_if(C.blocked(F.col("name"))).alias("n_blocked"), F.count("*").alias("n"))


@query(f"""{cte('torrent_files')} SELECT infohash, count(*) AS n_files, sum(size)::BIGINT AS total_size, count(*) FILTER (lower({_EXT.format('path')}) IN {_VIDEO}) AS n_video, count(*) FILTER ({_EXT.format('path')} IN {_VIDEO}) AS n_flagged FROM torrent_files GROUP BY infohash""")
def file_stats(spark, sf):
    return catalog.file_stats(view(spark, sf, "torrent_files"))


# --- reads --------------------------------------------------------------------
@query(f"{cte('torrents')} SELECT infohash, name, seeders, leechers FROM torrents WHERE state = 'active' ORDER BY seeders DESC, infohash LIMIT 50 OFFSET 25")
def search_all(spark, sf):
    return catalog.search_all(view(spark, sf, "torrents"), limit=50, offset=25).select("infohash", "name", "seeders", "leechers")


@query(f"{cte('torrents', 'tmdb_movies')} SELECT infohash, name, seeders, imdb_id, title, year FROM torrents JOIN tmdb_movies USING (infohash) WHERE state = 'active' ORDER BY seeders DESC, infohash LIMIT 100")
def search_movies(spark, sf):
    return catalog.search_movies(view(spark, sf, "torrents"), view(spark, sf, "tmdb_movies")).select("infohash", "name", "seeders", "imdb_id", "title", "year")


@query(f"{cte('torrents', 'tmdb_movies')} SELECT infohash, seeders, title FROM torrents JOIN tmdb_movies USING (infohash) WHERE state = 'active' AND imdb_id = 'tt1000012'")
def movies_by_imdb(spark, sf):
    return catalog.movies_by_imdb(view(spark, sf, "torrents"), view(spark, sf, "tmdb_movies"), "tt1000012").select("infohash", "seeders", "title")


@query(f"{cte('torrents', 'tmdb_tv')} SELECT infohash, seeders, series_name, season, episode FROM torrents JOIN tmdb_tv USING (infohash) WHERE state = 'active' AND season = 5 ORDER BY seeders DESC, infohash LIMIT 100")
def search_tv(spark, sf):
    return catalog.search_tv(view(spark, sf, "torrents"), view(spark, sf, "tmdb_tv"), season=5).select("infohash", "seeders", "series_name", "season", "episode")


@query(f"{cte('torrents', 'tmdb_tv')} SELECT infohash, seeders, season, episode FROM torrents JOIN tmdb_tv USING (infohash) WHERE state = 'active' AND imdb_id = 'tt2000013'")
def tv_by_imdb(spark, sf):
    return catalog.tv_by_imdb(view(spark, sf, "torrents"), view(spark, sf, "tmdb_tv"), "tt2000013").select("infohash", "seeders", "season", "episode")


@query(f"{cte('torrents')} SELECT infohash, name, state FROM torrents WHERE infohash = sha1('o42')")
def get_by_infohash(spark, sf):
    return view(spark, sf, "torrents").where(F.col("infohash") == F.sha1(F.lit("o42").cast("binary"))).select("infohash", "name", "state")


@query(f"{cte('torrents')} SELECT infohash, state, content_type, {sql_when('created_at')} FROM torrents WHERE state = 'active' AND content_type = 'tv' ORDER BY torrents.created_at DESC, infohash LIMIT 50")
def list_torrents(spark, sf):
    return catalog.list_torrents(view(spark, sf, "torrents"), "active", "tv", 50).select("infohash", "state", "content_type", when("created_at"))


@query(f"{cte('torrents')} SELECT count(*) AS n FROM torrents")
def count_torrents(spark, sf):
    return catalog.count(view(spark, sf, "torrents"))


@query(f"{cte('torrents')} SELECT state, count(*) AS n FROM torrents GROUP BY state")
def count_by_state(spark, sf):
    return catalog.count_by_state(view(spark, sf, "torrents"))


@query(f"{cte('torrents')} SELECT infohash, state, {sql_when('scrape_at')} FROM torrents WHERE (torrents.scrape_at IS NULL OR torrents.scrape_at < TIMESTAMP '{NOW}') AND state IN ('classified', 'enriched', 'active') ORDER BY torrents.scrape_at ASC NULLS FIRST, infohash LIMIT 740")
def due_to_scrape(spark, sf):
    return catalog.due(view(spark, sf, "torrents"), now(), 740).select("infohash", "state", when("scrape_at"))


@query(f"""{cte('torrents')}, d AS (SELECT infohash FROM torrents WHERE (scrape_at IS NULL OR scrape_at < TIMESTAMP '{NOW}') AND state IN ('classified', 'enriched', 'active') ORDER BY scrape_at ASC NULLS FIRST, infohash LIMIT 740)
SELECT infohash, ceil(row_number() OVER (ORDER BY infohash) / 74.0)::INT AS batch FROM d""")
def scrape_batches(spark, sf):
    return lifecycle.batches(catalog.due(view(spark, sf, "torrents"), now(), 740).select("infohash"))


@query(f"""{cte('torrents')} SELECT infohash, state FROM torrents WHERE seeders = 0 AND scrape_at IS NOT NULL AND state NOT IN ('dead', 'rejected') AND coalesce(last_seen, first_seen) < TIMESTAMP '{NOW}' ORDER BY coalesce(last_seen, first_seen), infohash LIMIT 1000""")
def dead_candidates(spark, sf):
    return catalog.dead_candidates(view(spark, sf, "torrents"), now()).select("infohash", "state")


@query(f"{cte('torrents', 'torrent_files')} SELECT t.infohash, count(f.path) AS n_files, coalesce(sum(f.size), 0)::BIGINT AS size FROM torrents t LEFT JOIN torrent_files f USING (infohash) GROUP BY t.infohash")
def torrents_with_files(spark, sf):
    rows = catalog.with_files(view(spark, sf, "torrents"), view(spark, sf, "torrent_files"))
    return rows.select("infohash", F.coalesce(F.size("files"), F.lit(0)).cast("long").alias("n_files"), F.coalesce(F.aggregate("files", F.lit(0).cast("long"), lambda a, f: a + f["size"]), F.lit(0)).alias("size"))


_WORDS = "list_filter(regexp_split_to_array(lower(translate(name, '._', '  ')), '[^a-z0-9]+'), lambda w: w <> '')"


@query(f"{cte('torrents')} SELECT infohash, name FROM torrents WHERE list_contains({_WORDS}, '1080p') AND list_contains({_WORDS}, 'bluray')")
def fts_simple(spark, sf):
    return view(spark, sf, "torrents").where(fts.matches(F.col("name"), "the BluRay 1080p")).select("infohash", "name")


@query(f"{cte('torrents')} SELECT infohash, name FROM torrents WHERE list_contains({_WORDS}, 'season')")
def fts_english(spark, sf):
    return fts.search_stemmed(view(spark, sf, "torrents"), "all the Seasons").select("infohash", "name")


@query(f"{cte('torrents')} SELECT infohash, name FROM torrents WHERE contains(lower(name), 'web-dl')")
def name_contains(spark, sf):
    return catalog.name_contains(view(spark, sf, "torrents"), "WEB-dl").select("infohash", "name")


# --- writes -------------------------------------------------------------------
@query(f"""{cte('torrents', 'discovered')} SELECT d.infohash, min(d.event_id) AS event_id FROM discovered d WHERE NOT EXISTS (SELECT 1 FROM torrents t WHERE t.infohash = d.infohash) GROUP BY d.infohash""")
def upsert_new(spark, sf):
    return dml.new_rows(view(spark, sf, "discovered").select("infohash", "event_id"), view(spark, sf, "torrents"), order="event_id")


@query(f"""{cte('torrent_files')} SELECT infohash, path, size, nullif({_EXT.format('path')}, '') AS extension, {_EXT.format('path')} IN {_VIDEO} AS is_video FROM torrent_files""")
def explode_files(spark, sf):
    lists = view(spark, sf, "torrent_files").groupBy("infohash").agg(F.collect_list("path").alias("paths"), F.collect_list("size").alias("sizes"))
    return dml.explode_files(lists)


@query(f"""{cte('torrents', 'torrent_files', 'scrape_history', 'tmdb_movies', 'tmdb_tv')}, k AS (SELECT infohash FROM torrents WHERE state = 'dead')
SELECT 'torrents' AS "table", count(*) AS n FROM torrents WHERE infohash NOT IN (SELECT infohash FROM k) UNION ALL SELECT 'torrent_files', count(*) FROM torrent_files WHERE infohash NOT IN (SELECT infohash FROM k)
UNION ALL SELECT 'scrape_history', count(*) FROM scrape_history WHERE infohash NOT IN (SELECT infohash FROM k) UNION ALL SELECT 'tmdb_movies', count(*) FROM tmdb_movies WHERE infohash NOT IN (SELECT infohash FROM k)
UNION ALL SELECT 'tmdb_tv', count(*) FROM tmdb_tv WHERE infohash NOT IN (SELECT infohash FROM k)""")
def delete_cascade(spark, sf):
    names = ("torrents", "torrent_files", "scrape_history", "tmdb_movies", "tmdb_tv")
    held = {n: view(spark, sf, n) for n in names}
    left = dml.delete_cascade(held, held["torrents"].where("state = 'dead'"))
    out = None
    for n in names:
        row = left[n].agg(F.count("*").alias("n")).select(F.lit(n).alias("table"), "n")
        out = row if out is None else out.union(row)
    return out


@query(f"""{cte('torrents')} SELECT infohash, CASE WHEN infohash = sha1('o42') THEN 'enriched' ELSE state END AS state FROM torrents""")
def update_state(spark, sf):
    import hashlib

    return dml.set_state(view(spark, sf, "torrents"), hashlib.sha1(b"o42").hexdigest(), "enriched").select("infohash", "state")


@query(f"""{cte('torrents')}, {_CLASSIFIED} SELECT infohash, coalesce(nullif(c.quality, ''), NULL) AS quality, c.content_type FROM classified c WHERE old_state = 'pending'
UNION ALL SELECT infohash, quality, content_type FROM torrents WHERE state <> 'pending'""")
def update_classified(spark, sf):
    t = view(spark, sf, "torrents", heavy=True)
    new = C.classify(t.where("state = 'pending'")).select("infohash", F.nullif("result.quality", F.lit("")).alias("quality"), F.col("result.content_type").alias("content_type"))
    return dml.overwrite(t, new, ["quality", "content_type"]).select("infohash", "quality", "content_type")


@query(f"""{cte('torrents')}, d AS (SELECT infohash FROM torrents WHERE seeders = 0 AND scrape_at IS NOT NULL AND state NOT IN ('dead', 'rejected') AND coalesce(last_seen, first_seen) < TIMESTAMP '{NOW}' - INTERVAL 90 DAY ORDER BY coalesce(last_seen, first_seen), infohash LIMIT 1000)
SELECT t.infohash, CASE WHEN d.infohash IS NOT NULL THEN 'dead' ELSE state END AS state FROM torrents t LEFT JOIN d USING (infohash)""")
def sweep_dead(spark, sf):
    return lifecycle.sweep_dead(view(spark, sf, "torrents"), now()).select("infohash", "state")


@query(f"""{cte('scrape_history')}, links AS (SELECT infohash, tracker_id, max(scraped_at) AS last_scrape FROM scrape_history GROUP BY 1, 2) SELECT infohash, tracker_id, {sql_when('links.last_scrape')}, true AS is_active FROM links""")
def upsert_links(spark, sf):
    h = view(spark, sf, "scrape_history").select("infohash", "tracker_id", F.col("scraped_at").alias("last_scrape"))
    old = h.where(F.col("last_scrape") < now()).groupBy("infohash", "tracker_id").agg(F.max("last_scrape").alias("last_scrape")).withColumn("is_active", F.lit(True))
    return dml.upsert_links(old, h.where(F.col("last_scrape") >= now())).select("infohash", "tracker_id", when("last_scrape"), "is_active")


@query(f"""{cte('trackers')} SELECT url, '{NOW}' AS updated_at FROM trackers WHERE id % 2 = 0 UNION SELECT 'udp://new.example:1', '{NOW}' UNION SELECT url, '1990-01-01 00:00:00' FROM trackers GROUP BY url HAVING count(*) FILTER (id % 2 = 0) = 0""")
def upsert_trackers(spark, sf):
    t = view(spark, sf, "trackers")
    old = t.groupBy("url").agg(F.min("id").alias("id")).select("id", "url", F.lit("1990-01-01 00:00:00").cast("timestamp").alias("created_at"), F.lit("1990-01-01 00:00:00").cast("timestamp").alias("updated_at"))
    asked = t.where("id % 2 = 0").select("url").union(spark.range(1).select(F.lit("udp://new.example:1").alias("url")))
    return dml.upsert_trackers(old, asked, now()).select("url", when("updated_at"))


@query(f"{cte('scrape_history')} SELECT infohash, tracker_id, {sql_when('scraped_at')}, seeders FROM scrape_history WHERE scrape_history.scraped_at >= TIMESTAMP '{NOW}' - INTERVAL 90 DAY")
def prune_history(spark, sf):
    return lifecycle.prune(view(spark, sf, "scrape_history"), now()).select("infohash", "tracker_id", when("scraped_at"), "seeders")


@query(f"""{cte('tmdb_tv')} SELECT 'season_sign' AS rule, count(*) FILTER (season <= 0) AS n FROM tmdb_tv UNION ALL SELECT 'episode_sign', count(*) FILTER (episode <= 0) FROM tmdb_tv UNION ALL SELECT 'key_unique', count(*) FROM (SELECT infohash FROM tmdb_tv GROUP BY 1 HAVING count(*) > 1)""")
def constraint_violations(spark, sf):
    return violations(view(spark, sf, "tmdb_tv"), "tmdb_tv")


# --- popularity ---------------------------------------------------------------
_BEST = "r AS (SELECT infohash, max(seeders) AS s, max(leechers) AS l FROM scrape_results GROUP BY infohash)"
_DELAY = "CASE WHEN {0} > 100 THEN 1 WHEN {0} >= 10 THEN 6 WHEN {0} >= 1 THEN 24 ELSE 168 END"


def _best(spark, sf):
    return view(spark, sf, "scrape_results").groupBy("infohash").agg(F.max("seeders").alias("seeders"), F.max("leechers").alias("leechers"))


@query(f"""{cte('torrents', 'scrape_results')}, {_BEST} SELECT t.infohash, coalesce(s, seeders) AS seeders, coalesce(l, leechers) AS leechers, CASE WHEN s > 0 AND state IN ('classified', 'enriched') THEN 'active' ELSE state END AS state,
 strftime(CASE WHEN s IS NULL THEN scrape_at ELSE TIMESTAMP '{NOW}' + {_DELAY.format('s')} * INTERVAL 1 HOUR END, '%Y-%m-%d %H:%M:%S') AS scrape_at, strftime(CASE WHEN s > 0 THEN TIMESTAMP '{NOW}' ELSE last_seen END, '%Y-%m-%d %H:%M:%S') AS last_seen
 FROM torrents t LEFT JOIN r USING (infohash)""")
def apply_scrape(spark, sf):
    return lifecycle.refresh(view(spark, sf, "torrents"), _best(spark, sf), 1, now())["torrents"].select("infohash", "seeders", "leechers", "state", when("scrape_at"), when("last_seen"))


@query(f"""{cte('torrents', 'scrape_results')}, {_BEST} SELECT infohash, 1::BIGINT AS tracker_id, '{NOW}' AS scraped_at, s AS seeders, l AS leechers FROM r WHERE infohash IN (SELECT infohash FROM torrents)""")
def scrape_history_rows(spark, sf):
    return lifecycle.refresh(view(spark, sf, "torrents"), _best(spark, sf), 1, now())["scrape_history"].select("infohash", "tracker_id", when("scraped_at"), "seeders", "leechers")


@query(f"{cte('torrents')} SELECT seeders, {_DELAY.format('seeders')} AS hours, count(*) AS n FROM torrents GROUP BY 1, 2")
def next_scrape_at(spark, sf):
    return view(spark, sf, "torrents").groupBy("seeders").agg(F.count("*").alias("n")).withColumn("hours", lifecycle.next_delay_hours(F.col("seeders")))


@query(f"""{cte('scrape_results')}, pick AS (SELECT coalesce(min(tracker_id) FILTER (any_seed), max(tracker_id)) AS tracker_id FROM (SELECT tracker_id, bool_or(seeders > 0) AS any_seed FROM scrape_results GROUP BY tracker_id))
SELECT tracker_id, infohash, seeders, leechers FROM scrape_results JOIN pick USING (tracker_id)""")
def tracker_fallback(spark, sf):
    rows = view(spark, sf, "scrape_results").withColumn("tracker_order", F.col("tracker_id"))
    return lifecycle.choose_tracker(rows).select("tracker_id", "infohash", "seeders", "leechers")


@query(f"{cte('trackers')} SELECT url, regexp_extract(url, '^udp://([^/?#\\s]+)', 1) AS host FROM trackers WHERE url LIKE 'udp://%'")
def tracker_hosts(spark, sf):
    return scrape.udp_hosts(view(spark, sf, "trackers"))


@query(f"""{cte('torrents')} SELECT infohash, seeders, 7::BIGINT AS completed, leechers FROM torrents WHERE state = 'active'""")
def scrape_reply(spark, sf):
    rows = view(spark, sf, "torrents").where("state = 'active'")
    word = lambda c: F.lpad(F.hex(c), 8, "0")
    packed = rows.withColumn("packet", F.substring("infohash", 1, 2)).withColumn("cell", F.struct("infohash", F.concat(word(F.col("seeders")), F.lit("00000007"), word(F.col("leechers"))).alias("hex")))
    packets = packed.groupBy("packet").agg(F.sort_array(F.collect_list("cell")).alias("cells"))
    asked = packets.select(F.transform("cells", lambda c: c["infohash"]).alias("hashes"), F.unhex(F.concat(F.lit("0000000200000001"), F.array_join(F.transform("cells", lambda c: c["hex"]), ""))).alias("reply"))
    return scrape.decode_reply(asked)


# --- nodes --------------------------------------------------------------------
_LIMBS = "[" + ", ".join(f"xor(('0x' || substr(node_id, {1 + 8 * i}, 8))::BIGINT, ('0x' || substr(target, {1 + 8 * i}, 8))::BIGINT)" for i in range(5)) + "]"
_TARGETS = "targets AS (SELECT sha1(concat('u', CAST(user_id AS VARCHAR))) AS target FROM events GROUP BY user_id)"


@query(f"""{cte('nodes')}, {_TARGETS}, d AS (SELECT target, node_id, row_number() OVER (PARTITION BY target ORDER BY {_LIMBS}, node_id) AS rank FROM nodes, targets WHERE failure_count < 3) SELECT target, node_id, rank FROM d WHERE rank <= 8""")
def xor_topk(spark, sf):
    targets = view(spark, sf, "discovered").select(F.col("infohash").alias("target")).distinct()
    return routing.nearest(targets, view(spark, sf, "nodes"), 8)


@query(f"""{cte('nodes')}, b AS (SELECT node_id, array_to_string(list_transform(range(1, 41), lambda i: ['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111', '1000', '1001', '1010', '1011', '1100', '1101', '1110', '1111'][instr('0123456789abcdef', substr(node_id, i, 1))]), '') AS bits,
 array_to_string(list_transform(range(1, 41), lambda i: ['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111', '1000', '1001', '1010', '1011', '1100', '1101', '1110', '1111'][instr('0123456789abcdef', substr(sha1('own'), i, 1))]), '') AS own FROM nodes)
SELECT node_id, len(list_filter(range(1, 161), lambda i: substr(bits, 1, i) = substr(own, 1, i)))::INT AS prefix FROM b""")
def common_prefix(spark, sf):
    return view(spark, sf, "nodes").select("node_id", ids.common_prefix(F.col("node_id"), F.sha1(F.lit("own").cast("binary"))).alias("prefix"))


def _duck_crc(number: str) -> str:
    crc, table = "4294967295::BIGINT", "[" + ", ".join(map(str, ids.CRC_TABLE)) + "]::BIGINT[]"
    for shift in (24, 16, 8, 0):
        crc = f"xor({crc} >> 8, ({table})[1 + (xor({crc}, ({number} >> {shift}) & 255) & 255)])"
    return f"xor({crc}, 4294967295::BIGINT)"


_SENDERS = "senders AS (SELECT event_id, ip, sha1(concat('n', CAST(event_id AS VARCHAR))) AS rest, event_id % 8 AS r, list_transform(string_split(ip, '.'), lambda x: x::BIGINT) AS p FROM discovered)"


# The SQL nests the checksum, so its four steps are columns of their own.
ORACLES["node_id_crc"] = f"""{cte('discovered')}, {_SENDERS},
s0 AS (SELECT event_id, (((p[1] << 24) + (p[2] << 16) + (p[3] << 8) + p[4]) & 51331071) | (r << 29) AS x, {ids.CRC_TABLE}::BIGINT[] AS t, 4294967295::BIGINT AS c FROM senders),
s1 AS (SELECT event_id, x, t, xor(c >> 8, t[1 + (xor(c, (x >> 24) & 255) & 255)]) AS c FROM s0), s2 AS (SELECT event_id, x, t, xor(c >> 8, t[1 + (xor(c, (x >> 16) & 255) & 255)]) AS c FROM s1),
s3 AS (SELECT event_id, x, t, xor(c >> 8, t[1 + (xor(c, (x >> 8) & 255) & 255)]) AS c FROM s2), s4 AS (SELECT event_id, xor(c >> 8, t[1 + (xor(c, x & 255) & 255)]) AS c FROM s3)
SELECT event_id, xor(c, 4294967295::BIGINT) AS crc FROM s4"""


@query(ORACLES["node_id_crc"])
def node_id_crc(spark, sf):
    rows = view(spark, sf, "discovered")
    seed = ids.ip_number(F.col("ip")).bitwiseAND(0x030F3FFF).bitwiseOR(F.shiftleft((F.col("event_id") % 8).cast("long"), 29))
    return rows.select("event_id", ids.crc32c(seed).alias("crc"))


_OWN = "8a5b3c7d" * 5
_BUCKETS = "buckets AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{low}', '{high}')" for i, low, high in routing.depth_buckets(_OWN, 6)) + ") AS v(bucket, low, high))"


@query(f"{cte('nodes')}, {_BUCKETS} SELECT node_id, bucket FROM nodes JOIN buckets ON node_id >= low AND (node_id < high OR high = repeat('0', 40))")
def bucket_of(spark, sf):
    table = spark.createDataFrame(routing.depth_buckets(_OWN, 6), "bucket int, low string, high string")
    return routing.bucket_of(view(spark, sf, "nodes"), table).select("node_id", "bucket")


@query(f"{cte('discovered')} SELECT event_id, ip, port FROM discovered")
def decode_peers(spark, sf):
    rows = view(spark, sf, "discovered").select("event_id", ids.encode_peer(F.col("ip"), F.col("port")).alias("b"))
    return rows.select("event_id", F.explode(ids.decode_peers(F.array("b"))).alias("p")).select("event_id", "p.ip", F.col("p.port").cast("long").alias("port"))


@query(f"{cte('discovered')} SELECT event_id, sha1(concat('n', CAST(event_id AS VARCHAR))) AS node_id, ip, port FROM discovered")
def decode_nodes(spark, sf):
    node = F.sha1(F.concat(F.lit("n"), F.col("event_id").cast("string")).cast("binary"))
    rows = view(spark, sf, "discovered").select("event_id", ids.encode_node(node, F.col("ip"), F.col("port")).alias("b"))
    return rows.select("event_id", F.explode(ids.decode_nodes(F.col("b"))).alias("n")).select("event_id", F.col("n.id").alias("node_id"), "n.addr.ip", F.col("n.addr.port").cast("long").alias("port"))


@query(f"{cte('nodes')} SELECT c_custkey, CASE WHEN failure_count >= 3 THEN 'bad' WHEN c_custkey % 1000 < 900 AND failure_count = 0 THEN 'good' ELSE 'questionable' END AS status FROM nodes")
def node_status(spark, sf):
    return view(spark, sf, "nodes").select("c_custkey", ids.node_status(F.col("c_custkey") % 1000, F.col("failure_count"), 900, 3).alias("status"))


@query("SELECT event_id, CASE WHEN event_id % 900 - 100 <= 0 THEN 300 ELSE least(greatest(event_id % 900 - 100, 60), 600) END AS seconds FROM events")
def interval_clamp(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.select("event_id", ids.clamp_interval(F.col("event_id") % 900 - 100, 300, 60, 600).alias("seconds"))


@query()
def ready_by_yield(spark, sf):
    rows = view(spark, sf, "nodes").select("node_id", ids.xor_hex(F.col("node_id"), F.lit(_OWN)).alias("dist"), (F.col("c_custkey") % 10).cast("double").alias("yield_factor"))
    return routing.ready_order(rows, 64).select("node_id", "key")


@query()
def routing_replay(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    kind = F.when(F.col("event_id") % 5 == 4, "failure").when(F.col("event_id") % 5 == 3, "success").otherwise("insert")
    node = F.sha1(F.concat(F.lit("n"), (F.col("event_id") % 400).cast("string")).cast("binary"))
    rows = e.select(F.sha1(F.concat(F.lit("own"), (F.col("user_id") % 16).cast("string")).cast("binary")).alias("own_id"), F.col("event_id").alias("seq"), kind.alias("kind"), node.alias("node_id"), F.lit("10.0.0.1:1").alias("addr"), F.col("event_id").cast("double").alias("at"))
    return routing.replay(rows)


_PLACED = "placed AS (SELECT node_id, failure_count, concat('10.0.', CAST(CAST(floor(c_custkey / 256) AS BIGINT) % 256 AS VARCHAR(9)), '.', CAST(c_custkey % 256 AS VARCHAR(9))) AS ip, CAST(1024 + c_custkey % 1000 AS INT) AS port FROM nodes)"


def _placed(spark, sf):
    ip = F.concat(F.lit("10.0."), (F.floor(F.col("c_custkey") / 256) % 256).cast("string"), F.lit("."), (F.col("c_custkey") % 256).cast("string"))
    return view(spark, sf, "nodes").select("node_id", "failure_count", ip.alias("ip"), (1024 + F.col("c_custkey") % 1000).cast("int").alias("port"))


@query(f"""{cte('nodes')}, {_PLACED}, {_TARGETS}, d AS (SELECT target, node_id, ip, port, row_number() OVER (PARTITION BY target ORDER BY {_LIMBS}, node_id) AS rank FROM placed, targets WHERE failure_count < 3) SELECT target, node_id, ip, port, rank FROM d WHERE rank <= 8""")
def find_node_replies(spark, sf):
    asked = view(spark, sf, "discovered").select(F.col("infohash").alias("h")).distinct().select(F.struct(F.lit(None).cast("string").alias("target"), F.col("h").alias("info_hash")).alias("a"))
    sent = messages.find_node_replies(asked, _placed(spark, sf))
    return sent.select("target", F.posexplode(ids.decode_nodes(F.col("nodes"))).alias("i", "n")).select("target", F.col("n.id").alias("node_id"), "n.addr.ip", "n.addr.port", (F.col("i") + 1).alias("rank"))


@query("SELECT event_type, count(*) FILTER (event_id % 4 <> 0 AND event_id % 30 <= 20) AS answered, count(*) AS n FROM events GROUP BY event_type")
def correlate_replies(spark, sf):
    e = view(spark, sf, "discovered").join(spark.read.parquet(f"{sf}/events.parquet").select("event_id", "event_type"), "event_id")
    asked = e.select(F.col("event_id").cast("string").alias("t"), F.col("seen_at").alias("sent_at"), "event_type")
    told = e.where("event_id % 4 <> 0").select(F.col("event_id").cast("string").alias("t"), (F.col("seen_at") + F.make_dt_interval(secs=(F.col("event_id") % 30).cast("double"))).alias("at"))
    got = messages.correlate(asked, told, 20).join(asked.select("t", "event_type"), "t")
    return got.groupBy("event_type").agg(F.count_if("answered").alias("answered"), F.count("*").alias("n"))


@query(f"{cte('nodes')}, {_PLACED} SELECT node_id, ip, port, failure_count AS failures FROM placed")
def node_json(spark, sf):
    rows = _placed(spark, sf).select("node_id", "ip", "port", now().alias("last_seen"), F.col("failure_count").alias("failures"))
    return messages.parse_node_json(messages.node_json(rows)).select("node_id", "ip", "port", F.col("failures").cast("long").alias("failures"))


@query("SELECT event_type AS y, count(*) AS n FROM events WHERE event_type IN ('click', 'view') GROUP BY 1")
def route_messages(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    m = e.select(F.when(F.col("event_type") == "click", "q").when(F.col("event_type") == "view", "r").otherwise("z").alias("y"), F.lit("ping").alias("q"), "event_type")
    parts = messages.routed(m)
    return parts["queries"].union(parts["transactions"]).groupBy(F.col("event_type").alias("y")).agg(F.count("*").alias("n"))


# --- streams, as batches ------------------------------------------------------
@query("""WITH RECURSIVE d AS (SELECT user_id, floor(epoch(ts) / 1800)::BIGINT AS w, min(ts) AS ts FROM events GROUP BY 1, 2),
walk AS (SELECT user_id, min(w) AS w FROM d GROUP BY user_id UNION ALL SELECT walk.user_id, (SELECT min(d.w) FROM d WHERE d.user_id = walk.user_id AND d.w >= walk.w + 2) FROM walk WHERE (SELECT min(d.w) FROM d WHERE d.user_id = walk.user_id AND d.w >= walk.w + 2) IS NOT NULL)
SELECT sha1(concat('u', CAST(user_id AS VARCHAR))) AS infohash, count(*) AS n FROM walk GROUP BY user_id""")
def dedup_discovered(spark, sf):
    return state.rotating_dedup(view(spark, sf, "discovered"), 1800).groupBy("infohash").agg(F.count("*").alias("n"))


@query(f"{cte('fetch_results')} SELECT infohash, min(seq) AS seq, arg_min(name, seq) AS name FROM fetch_results WHERE ok AND peer_rank < 20 GROUP BY infohash")
def first_metadata_wins(spark, sf):
    return lifecycle.first_metadata(view(spark, sf, "fetch_results"), 20).select("infohash", "seq", "name")


@query(f"""{cte('fetch_results')}, torrents AS (SELECT infohash, arg_min(name, seq) AS name, arg_min(total_size, seq) AS total_size, 'pending' AS state, 'unknown' AS content_type FROM fetch_results WHERE ok AND peer_rank < 20 GROUP BY infohash), {_CLASSIFIED}
SELECT infohash, name, content_type, CASE WHEN total_size < 52428800 OR total_size > 161061273600 OR adult OR software OR content_type = 'unknown' THEN 'rejected' ELSE 'classified' END AS state FROM classified WHERE NOT {_m(_NORM.format('name'), P.BLOCKED)} AND infohash NOT IN (SELECT infohash FROM fetch_results WHERE seq % 700 < 100)""")
def ingest_batch(spark, sf):
    fetched = view(spark, sf, "fetch_results")
    stored = fetched.where("seq % 700 < 100").select("infohash")  # a hundred of the keys are known
    return ingest.ingest(fetched, stored, now(), 20)["torrents"].select("infohash", "name", "content_type", "state")


# --- metrics and serving ------------------------------------------------------
@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def metrics_counter(spark, sf):
    return metrics.counter(spark.read.parquet(f"{sf}/events.parquet"), "event_type")


@query("SELECT event_type, max({'ts': ts, 'value': value}).value AS value FROM events GROUP BY event_type")
def metrics_gauge(spark, sf):
    return metrics.gauge(spark.read.parquet(f"{sf}/events.parquet"), "value", "ts", "event_type")


@query("SELECT event_type, b.le, count(*) FILTER (value <= b.le) AS n, count(*) AS total FROM events, (SELECT unnest([0, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144, 233]::DOUBLE[] || ['inf'::DOUBLE]) AS le) b GROUP BY ALL")
def metrics_histogram(spark, sf):
    return metrics.histogram(spark.read.parquet(f"{sf}/events.parquet"), "value", metrics.PEER_COUNTS, "event_type").select("event_type", "le", "n", "total")


@query("SELECT count(*) FILTER (event_id % 3 > 0) AS \"new\", count(*) FILTER (event_id % 3 = 1) AS dropped, count(*) - count(*) FILTER (event_id % 3 > 0) - count(*) FILTER (event_id % 3 = 1) AS duplicate, count(*) - count(*) FILTER (event_id % 3 > 0) AS duplicate_exact FROM events")
def queue_outcomes(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    return metrics.queue_outcomes(e.select(F.when(F.col("event_id") % 3 == 0, "duplicate").when(F.col("event_id") % 3 == 1, "dropped").otherwise("new").alias("outcome")))


@query(f"{cte('torrents')} SELECT infohash, 'magnet:?xt=urn:btih:' || infohash || '&dn=' || replace(url_encode(name), '%20', '+') AS url FROM torrents")
def magnet_url(spark, sf):
    return view(spark, sf, "torrents").select("infohash", text.magnet(F.col("infohash"), F.col("name")).alias("url"))


_CATS = """CASE content_type WHEN 'movie' THEN CASE WHEN quality IN ('2160p', '4K') THEN '2000,2045' WHEN quality = '1080p' THEN '2000,2040' WHEN quality = '720p' THEN '2000,2030' ELSE '2000' END
 WHEN 'tv' THEN CASE WHEN quality IN ('2160p', '4K') THEN '5000,5045' WHEN quality = '1080p' THEN '5000,5040' WHEN quality = '720p' THEN '5000,5030' ELSE '5000' END WHEN 'anime' THEN '5070' ELSE '2000,5000' END"""


@query(f"{cte('torrents')} SELECT infohash, {_CATS} AS categories FROM torrents")
def categories(spark, sf):
    return view(spark, sf, "torrents").select("infohash", F.array_join(text.categories(F.col("content_type"), F.col("quality")), ",").alias("categories"))


def _duck_attr(name: str, value: str) -> str:
    return f"""'<torznab:attr name="{name}" value="' || {value} || '"></torznab:attr>'"""


@query(f"""{cte('torrents')}, l AS (SELECT *, 'magnet:?xt=urn:btih:' || infohash || '&amp;dn=' || replace(url_encode(name), '%20', '+') AS link, string_split({_CATS}, ',') AS cats FROM torrents)
SELECT infohash, '<item><title>' || name || '</title><guid isPermaLink="false">' || infohash || '</guid><link>' || link || '</link><enclosure url="' || link || '" length="' || total_size || '" type="{serve.LINK_TYPE}"></enclosure><size>' || total_size || '</size><pubDate>'
 || strftime(first_seen, '%a, %d %b %Y %H:%M:%S +0000') || '</pubDate>' || {_duck_attr('seeders', 'seeders')} || {_duck_attr('leechers', 'leechers')} || {_duck_attr('infohash', 'infohash')}
 || array_to_string(list_transform(cats, lambda c: {_duck_attr('category', 'c')}), '') || CASE WHEN quality IS NULL THEN '' ELSE {_duck_attr('resolution', 'quality')} END || '</item>' AS item FROM l""")
def rss_items(spark, sf):
    return serve.items(view(spark, sf, "torrents"))


@query(f"{cte('torrents')} SELECT infohash, state, count(*) OVER () AS n FROM (SELECT infohash, state FROM torrents WHERE state = 'active' AND list_contains({_WORDS}, 'hdtv') ORDER BY seeders DESC, infohash LIMIT 20)")
def torznab_search(spark, sf):
    rows = serve.search(serve.parse({"t": "search", "q": "hdtv", "limit": "20", "cat": "2000,x"}), {"torrents": view(spark, sf, "torrents")})
    from pyspark.sql import Window

    return rows.select("infohash", "state", F.count("*").over(Window.partitionBy(F.lit(1))).alias("n"))


@query(f"{cte('torrents')} SELECT infohash, seeders, state FROM torrents")
def json_rows(spark, sf):
    rows = serve.to_json(view(spark, sf, "torrents").select("infohash", "seeders", "state"))
    return rows.select(F.from_json("json", "infohash string, seeders long, state string").alias("j")).select("j.*")


@query("SELECT event_id, CASE WHEN event_id >= 1 << 20 THEN printf('%.1f MB', floor(event_id / 1048576.0 * 10 + 0.5) / 10) WHEN event_id >= 1024 THEN printf('%.1f KB', floor(event_id / 1024.0 * 10 + 0.5) / 10) ELSE event_id || ' B' END AS size FROM events")
def human_sizes(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", text.human_size(F.col("event_id")).alias("size"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classified names of active movies with their links and categories, best seeded first."""
    rows = C.classify(view(spark, sf_dir, "torrents"))
    page = catalog.search_movies(rows, view(spark, sf_dir, "tmdb_movies").withColumnRenamed("title", "movie_title"))
    return page.select("infohash", "name", "seeders", "imdb_id", "movie_title", "result.title", "result.year", "result.encoding", text.magnet(F.col("infohash"), F.col("name")).alias("magnet"), text.categories(F.col("content_type"), F.col("quality")).alias("categories"))

"""Release names and file lists to content type, tags, title and verdict, as native expressions.

Columns are built in layers, so that a long expression is computed once and used by name.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heronlake.functions import patterns as P

MIB, GIB = 1 << 20, 1 << 30
#: Extensions that a release may hold besides video.
ALLOWED = (".mkv", ".mp4", ".avi", ".mov", ".wmv", ".m4v", ".ts", ".m2ts", ".vob", ".flv", ".webm", ".srt", ".ass", ".ssa", ".sub")


@dataclass(frozen=True)
class Settings:
    min_size: int = 50 * MIB
    max_size: int = 150 * GIB
    allowed: tuple[str, ...] = field(default=ALLOWED)
    extension_filter: bool = True
    exclude_adult: bool = True


def _has(c: Column, pattern: str) -> Column:
    return c.rlike(P.java(pattern))


def _first(c: Column, pattern: str, group: int = 0) -> Column:
    """The first match or its group, '' for none."""
    return F.regexp_extract(c, P.java(pattern), group)


def normalize(name: Column) -> Column:
    """Dots and underscores as spaces, and single spaces between words."""
    return F.trim(F.regexp_replace(F.translate(name, "._", "  "), P.UNICODE_SPACE, " "))


def extension(path: Column) -> Column:
    """From the last dot after the last slash, with the dot; '' if there is none."""
    return F.regexp_extract(path, r"(\.[^./]*)\z", 1)


def is_video(ext: Column) -> Column:
    return ext.isin(*P.VIDEO_EXTENSIONS)


def trim_title(s: Column) -> Column:
    return F.regexp_replace(F.trim(s), r"[ \-–_.(\[]+\z", "")


def blocked(name: Column, files: Column | None = None) -> Column:
    """The safety gate over a name and all paths (``files``: structs with a ``path``)."""
    hit = _has(normalize(F.coalesce(name, F.lit(""))), P.BLOCKED)
    if files is not None:
        hit = hit | F.exists(F.coalesce(files, F.array()), lambda f: _has(normalize(F.coalesce(f["path"], F.lit(""))), P.BLOCKED))
    return hit


def _number(s: Column) -> Column:
    return F.coalesce(s.try_cast("int"), F.lit(0))


def tv_marks(mark: Column, pack: Column) -> tuple[Column, Column, Column]:
    """Whether a name is of a series, its season and its episode (0 for none), from its first episode and season marks.

    The mark's parts are read from the mark alone, which matches as it did in the name.
    """
    season = F.when(mark != "", _number(_first(mark, P.MARK_SEASON, 1))).when(pack != "", _number(_first(pack, P.SEASON, 1))).otherwise(F.lit(0))
    episode = F.when(mark != "", _number(_first(mark, P.MARK_EPISODE, 1))).otherwise(F.lit(0))
    return (mark != "") | (pack != ""), season, episode


def anime(name: Column, normalized: Column, plain: Column, inner: Column, is_tv: Column, adult: Column) -> Column:
    """``plain``: the normalized name without codecs; ``inner``: the name without a site in brackets before it."""
    bracketed = _has(inner, P.BRACKET_PREFIX) & (_has(plain, P.BARE_EPISODE) | _has(inner, P.BRACKET_EPISODE))
    return ~adult & (_has(plain, P.EP_NUMBER) | bracketed | (is_tv & (_has(name, P.FANSUB) | _has(normalized, P.STREAMING))))


def video_count(files: Column) -> Column:
    return F.size(F.filter(files, lambda f: is_video(F.lower(extension(f["path"])))))


def bad_count(files: Column, allowed: tuple[str, ...]) -> Column:
    """Files that are neither video nor allowed."""
    return F.size(F.filter(files, lambda f: ~F.lower(extension(f["path"])).isin(*P.VIDEO_EXTENSIONS, *allowed)))


#: What :func:`classify` adds.
RESULT = ("state", "content_type", "rejection_reason", "title", "year", "season", "episode", "quality", "encoding", "dynamic_range", "source", "release_group", "scene_name")


def classify(df: DataFrame, settings: Settings | None = None) -> DataFrame:
    """``df`` (``name``, ``total_size`` and, optionally, ``files``) with the column ``result``, a struct of :data:`RESULT`; '' and 0 for what a name lacks."""
    s = settings or Settings()
    own = df.columns
    files = F.coalesce(F.col("files"), F.array()) if "files" in own else None
    name = F.coalesce(F.col("name"), F.lit(""))
    out = df.withColumn("__n", F.regexp_replace(normalize(name), P.java(P.SITE_PREFIX), ""))
    n = F.col("__n")
    out = out.withColumns({"__mark": _first(n, P.EPISODE), "__pack": _first(n, P.SEASON), "__year": _number(_first(n, P.YEAR, 1)), "__plain": F.regexp_replace(n, P.java(P.CODEC_TOKEN), ""), "__inner": F.regexp_replace(name, P.java(P.BRACKET_SITE), "")})
    tv, season, episode = tv_marks(F.col("__mark"), F.col("__pack"))
    out = out.withColumns({"__tv": tv, "__season": season, "__episode": episode, "__adult": _has(name, P.ADULT) | _has(n, P.ADULT), "__quality": _first(n, P.RESOLUTION)})
    out = out.withColumn("__anime", anime(name, n, F.col("__plain"), F.col("__inner"), F.col("__tv"), F.col("__adult")))
    kind = F.when(F.col("__anime"), "anime").when(F.col("__tv"), "tv").when((F.col("__year") > 0) | (F.col("__quality") != ""), "movie").otherwise("unknown")
    cut = F.when(F.col("__anime"), _first(F.regexp_replace(n, P.java(P.BRACKET_PREFIX), ""), P.ANIME_TITLE, 1)).otherwise(_first(n, P.TITLE, 1))
    stem = F.when(is_video(F.lower(extension(name))), F.regexp_replace(name, r"\.[^./]*\z", "")).otherwise(name)
    out = out.withColumns({"__kind": kind, "__title": trim_title(cut), "__group": _first(stem, P.RELEASE_GROUP, 1)})
    size = F.coalesce(F.col("total_size"), F.lit(0))
    reason = F.when((size < s.min_size) | (size > s.max_size), "size")
    if s.exclude_adult:
        reason = reason.when(F.col("__adult"), "adult")
    reason = reason.when(_has(name, P.SOFTWARE) | _has(n, P.SOFTWARE), "software").when(F.col("__kind") == "unknown", "unknown_type")
    if files is not None:
        reason = reason.when((F.size(files) > 0) & (video_count(files) == 0), "no_video")
        if s.extension_filter:
            reason = reason.when((F.size(files) > 0) & (bad_count(files, s.allowed) > 0), "bad_extension")
    out = out.withColumn("__reason", reason.otherwise(""))
    serial = F.col("__anime") | F.col("__tv")
    fields = {
        "state": F.when(F.col("__reason") == "", "classified").otherwise("rejected"), "content_type": F.col("__kind"), "rejection_reason": F.col("__reason"), "title": F.col("__title"), "year": F.col("__year"),
        "season": F.when(serial, F.col("__season")).otherwise(0), "episode": F.when(serial, F.col("__episode")).otherwise(0), "quality": F.col("__quality"), "encoding": _first(n, P.ENCODING), "dynamic_range": _first(n, P.DYNAMIC_RANGE),
        "source": _first(n, P.SOURCE), "release_group": F.col("__group"), "scene_name": name,
    }
    return out.withColumn("result", F.struct(*(c.alias(k) for k, c in fields.items()))).select(*own, "result")


def resolve_state(current: Column, classified: Column) -> Column:
    """Only pending and rejected rows take a new verdict."""
    return F.when(current.isin("pending", "rejected"), classified).otherwise(current)


def nulled(result: str = "result") -> dict[str, Column]:
    """The columns to store: '' and 0 as null."""
    text = {"classified_title": "title", "quality": "quality", "encoding": "encoding", "dynamic_range": "dynamic_range", "source": "source", "release_group": "release_group", "scene_name": "scene_name"}
    number = {"classified_year": "year", "classified_season": "season", "classified_episode": "episode"}
    return {k: F.nullif(F.col(f"{result}.{v}"), F.lit("")) for k, v in text.items()} | {k: F.nullif(F.col(f"{result}.{v}"), F.lit(0)) for k, v in number.items()}


def reclassify(torrents: DataFrame, files: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Torrents whose type or state would change: ``infohash, name, old_type, old_state, new_type, new_state`` and the columns to store."""
    lists = files.groupBy("infohash").agg(F.collect_list(F.struct("path", "size")).alias("files"))  # one release's files
    rows = classify(torrents.join(lists, "infohash", "left"), settings)
    new_state = resolve_state(F.col("state"), F.col("result.state"))
    rows = rows.withColumns({"new_state": new_state, "new_type": F.col("result.content_type")})
    changed = ~(F.col("content_type").eqNullSafe(F.col("new_type")) & F.col("state").eqNullSafe(F.col("new_state")))
    return rows.where(changed).select("infohash", "name", F.col("content_type").alias("old_type"), F.col("state").alias("old_state"), "new_type", "new_state", *(c.alias(f"set_{k}") for k, c in nulled().items()))


def diff_line(rows: DataFrame) -> DataFrame:
    """What a dry run prints for each change."""
    return rows.select(F.format_string('%s "%s": content_type %s→%s, state %s→%s', "infohash", "name", "old_type", "new_type", "old_state", "new_state").alias("line"))

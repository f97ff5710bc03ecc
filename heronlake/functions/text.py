"""Scalar functions of serving: links, categories, dates, sizes and markup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Category numbers.
CATEGORIES = {
    "Movies": (2000, {"SD": 2030, "HD": 2040, "UHD": 2045, "BluRay": 2050, "Foreign": 2010, "Other": 2020, "3D": 2060}),
    "TV": (5000, {"SD": 5030, "HD": 5040, "UHD": 5045, "Anime": 5070, "Documentary": 5080}),
}


def query_escape(s: Column) -> Column:
    """Form encoding: spaces as plus, ``~`` bare, ``*`` escaped."""
    return F.replace(F.replace(F.url_encode(s), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def magnet(infohash: Column, name: Column) -> Column:
    return F.concat(F.lit("magnet:?xt=urn:btih:"), infohash, F.lit("&dn="), query_escape(name))


def categories(content_type: Column, quality: Column) -> Column:
    """By type and exact quality; unknown types are both."""
    def of(kind: str) -> Column:
        top, sub = CATEGORIES[kind]
        two = lambda k: F.array(F.lit(top), F.lit(sub[k]))
        return F.when(quality.isin("2160p", "4K"), two("UHD")).when(quality == "1080p", two("HD")).when(quality == "720p", two("SD")).otherwise(F.array(F.lit(top)))

    return F.when(content_type == "movie", of("Movies")).when(content_type == "tv", of("TV")).when(content_type == "anime", F.array(F.lit(CATEGORIES["TV"][1]["Anime"]))).otherwise(F.array(F.lit(2000), F.lit(5000)))


def mail_date(ts: Column) -> Column:
    """Day, date, time and zone in UTC; '' for null."""
    return F.coalesce(F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss xx"), F.lit(""))


def escape(s: Column) -> Column:
    """For markup text and attributes."""
    out = s
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;"), ("\t", "&#x9;"), ("\n", "&#xA;"), ("\r", "&#xD;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def clean_utf8(b: Column) -> Column:
    """Bytes as text without what is not UTF-8 (and without U+FFFD itself)."""
    return F.replace(F.make_valid_utf8(b), F.lit("�"), F.lit(""))


def human_size(n: Column) -> Column:
    out = F.concat(n.cast("string"), F.lit(" B"))
    for power, unit in ((1, "KB"), (2, "MB"), (3, "GB"), (4, "TB")):
        out = F.when(n >= 1 << (10 * power), F.format_string("%.1f " + unit, n / float(1 << (10 * power)))).otherwise(out)
    return out


def truncate(s: Column, n: int) -> Column:
    return F.when(F.length(s) > n, F.concat(F.substring(s, 1, n - 1), F.lit("…"))).otherwise(s)


def port(s: Column) -> Column:
    p = F.trim(s).try_cast("int")
    return F.when(p.between(1, 65535), p)


def blank(c: Column, kind: str) -> Column:
    """Null as the empty value of its kind: text, number."""
    return F.coalesce(c, F.lit("") if kind == "text" else F.lit(0))


def next_option(options: list[str], now: str) -> str:
    """The option after this one, round and round; the first for an unknown one."""
    return options[(options.index(now) + 1) % len(options)] if now in options else options[0]


def log_level(s: str | None) -> str:
    """A known level's name, else info."""
    return s.lower() if s and s.lower() in ("debug", "info", "warn", "error") else "info"

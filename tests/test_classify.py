"""Names with known verdicts, and the pattern translation."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from heronlake.functions import classify as C
from heronlake.functions import patterns as P

GIB = 1 << 30
# name, type, title, year, season, episode, other fields
NAMES = [
    ("The.Dark.Knight.2008.1080p.BluRay.x264-GROUP", "movie", "The Dark Knight", 2008, 0, 0, {"quality": "1080p", "encoding": "x264", "source": "BluRay", "release_group": "GROUP"}),
    ("Seinfeld.5x12.The.Stall.DVDRip.x264", "tv", "Seinfeld", 0, 5, 12, {"release_group": "", "source": "DVDRip"}),
    ("Succession.S04E03.1080p.WEB-DL.H.264-GROUP", "tv", "Succession", 0, 4, 3, {"encoding": "", "source": "WEB-DL"}),
    ("Show.S02E03E04.1080p.WEB-DL.x264-GROUP", "tv", "Show", 0, 2, 3, {}),
    ("[Adosin] Bleach 168-189 (BD 1080p HEVC FLAC)", "anime", "Bleach", 0, 0, 0, {"encoding": "HEVC"}),
    ("[SubsPlease] Enen no Shouboutai S3 - 01 (1080p) [695F5A4A].mkv", "anime", "Enen no Shouboutai", 0, 3, 1, {}),
    ("Some.Random.Content.HDTV.x264", "unknown", "Some Random Content", 0, 0, 0, {"rejection_reason": "unknown_type", "state": "rejected"}),
    ("Film.Name.2019.2160p.HDR10+.mkv", "movie", "Film Name", 2019, 0, 0, {"dynamic_range": "HDR10", "quality": "2160p"}),
    ("www.Site.org - Film.2019.720p", "movie", "Film", 2019, 0, 0, {"quality": "720p"}),
    ("Show.EP123.576p", "anime", "Show", 0, 0, 123, {}),
    ("Show_S01E05_Crunchyroll_WEBRip", "anime", "Show", 0, 1, 5, {"source": "WEBRip"}),
    ("Show Ep7 HDTV", "tv", "Show Ep7", 0, 0, 7, {}),
    ("Show 12x100 PDTV", "tv", "Show", 0, 12, 100, {}),
    ("Film.XXX.2011.1080p", "movie", "Film XXX", 2011, 0, 0, {"rejection_reason": "adult"}),
    ("Tool.x64.2020.1080p", "movie", "Tool x64", 2020, 0, 0, {"rejection_reason": "software"}),
    ("", "unknown", "", 0, 0, 0, {"rejection_reason": "unknown_type"}),
]


def test_names(spark):
    rows = spark.createDataFrame([(n, 2 * GIB) for n, *_ in NAMES], "name string, total_size long")
    got = {r["name"]: r["result"] for r in C.classify(rows).collect()}
    for name, kind, title, year, season, episode, more in NAMES:
        r = got[name]
        assert (r.content_type, r.title, r.year, r.season, r.episode) == (kind, title, year, season, episode), name
        assert {k: r[k] for k in more} == more, name


@pytest.mark.parametrize(
    ("size", "files", "reason"),
    [(1, [], "size"), (200 * GIB, [], "size"), (GIB, ["a.mkv", "b.srt"], ""), (GIB, ["a.txt"], "no_video"), (GIB, ["a.MKV", "b.exe"], "bad_extension"), (GIB, [], ""), (GIB, ["dir.mkv/readme"], "no_video")],
)
def test_rejections(spark, size, files, reason):
    rows = spark.createDataFrame([("Film.2001.720p", size, [(f, 1) for f in files])], "name string, total_size long, files array<struct<path:string,size:long>>")
    assert C.classify(rows).first()["result"]["rejection_reason"] == reason


def test_adult_only_if_excluded(spark):
    rows = spark.createDataFrame([("Some.XXX.Film.2001.720p", GIB)], "name string, total_size long")
    assert C.classify(rows).first()["result"]["rejection_reason"] == "adult"
    assert C.classify(rows, C.Settings(exclude_adult=False)).first()["result"]["rejection_reason"] == ""


def test_gate_looks_at_names_and_paths(spark):
    rows = spark.createDataFrame([("opva_set", ["a"]), ("fine", ["x/pthc.mkv"]), ("fine", ["a.mkv"]), (None, None)], "name string, p array<string>")
    files = rows.selectExpr("name", "transform(p, x -> named_struct('path', x)) AS files")
    assert [r[0] for r in files.select(C.blocked(files["name"], files["files"])).collect()] == [True, True, False, False]


def test_edges_are_ascii(spark):
    rows = spark.createDataFrame([("éDVé",), ("aDVb",), ("DV",), ("x DV\n",)], "s string")
    assert [r[0] for r in rows.select(rows["s"].rlike(P.java(r"\bDV\b"))).collect()] == [True, False, True, True]
    assert [r[0] for r in rows.select(rows["s"].rlike(P.java("DV$"))).collect()] == [False, False, True, False]


def test_grouped_words_match_what_plain_words_do(spark):
    """Alternatives by their first letter against the lists as they are, also beside letters that fold to ASCII ones."""
    r = random.Random(3)
    lists = {"ADULT": P.ADULT_WORDS, "SOFTWARE": P.SOFTWARE_WORDS, "BLOCKED": P.BLOCKED_WORDS}
    plain = {k: [re.sub(r"\\b|\\w\*|\(\?:|[()?*^$\\]", "", w) for w in v.split("|")] for k, v in lists.items()}
    around = ["", "", " ", "x", "_", "é", "ſ", "\u212a", "9", "-", "s", "ing"]
    texts = [r.choice(around) + r.choice((str, str.upper, str.title))(r.choice(plain[k])) + r.choice(around) for k in lists for _ in range(1500)]
    rows = spark.createDataFrame([(t,) for t in texts], "s string")
    for k, words in lists.items():
        got = rows.select("s", rows["s"].rlike(P.java(getattr(P, k))).alias("grouped"), rows["s"].rlike(P.java(f"(?i){words}")).alias("plain")).collect()
        assert 100 < sum(x.grouped for x in got) and [x.s for x in got if x.grouped != x.plain] == []


def test_numbers_of_marks(spark):
    marks = ["S01E02", "s1e3", "S02E03E04", "S01E02-03", "5x12", "12x100", "Ep.5", "EP12", "ep123", "EP1234", "S3 - 01", "S3  –  0123"]
    rows = spark.createDataFrame([(m,) for m in marks], "s string")
    first = lambda *groups: F.coalesce(*(F.nullif(F.regexp_extract("s", P.java(P.EPISODE), g), F.lit("")) for g in groups), F.lit(""))
    got = rows.select("s", F.regexp_extract("s", P.java(P.MARK_SEASON), 1), first(1, 3, 6), F.regexp_extract("s", P.java(P.MARK_EPISODE), 1), first(2, 4, 5, 7, 8)).collect()
    assert [x for x in got if x[1] != x[2] or x[3] != x[4] or not x[3]] == []


def test_stages_compile(spark):
    """No stage of the classifier is beyond what one generated method may hold."""
    rows = spark.createDataFrame([("Film.2001.720p", 1 << 30)], "name string, total_size long").repartition(1)
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        assert C.classify(rows).first()["result"]["title"] == "Film"
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")


def test_only_open_rows_take_a_verdict(spark):
    rows = spark.createDataFrame([("pending",), ("rejected",), ("active",), ("dead",)], "state string")
    assert [r[0] for r in rows.select(C.resolve_state(F.col("state"), F.lit("classified"))).collect()] == ["classified", "classified", "active", "dead"]

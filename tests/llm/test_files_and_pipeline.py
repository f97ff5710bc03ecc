from __future__ import annotations

import base64
import hashlib
import io
import zipfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from heronlake.llm import _store, compaction, warc_zip


def _page_rows():
    return [(1, "http://a/x", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "http://b/ y\r\n", "<p>é</p>"), (4, "u", None), (5, "u", ""), (6, "u", "long " * 100_000), (7, "u", "one"), (7, "u", "one"), (None, "u", "one"), (None, "u", "alone"), (8, "", "\x00\r\n\r\n")]


def test_archives(spark):
    pages = spark.createDataFrame(_page_rows(), "page_id long, url string, html string").selectExpr("*", "1 AS sha", "2 AS refers_to", "3 AS package")
    got = [tuple(r) for r in warc_zip.write_and_read(pages).collect()]
    first = {}
    for i, _, h in _page_rows():
        if i is not None:
            first[h or ""] = max(first.get(h or "", i), i)
    expect = []
    for i, _, h in _page_rows():
        b, top = (h or "").encode(), first.get(h or "")
        again = i is not None and i < top
        expect.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", top if again else None))
    assert sorted(map(str, got)) == sorted(map(str, expect))
    assert warc_zip.write_and_read(pages.limit(0)).count() == 0


def test_payloads_come_back_whole(spark):
    pages = spark.createDataFrame(_page_rows(), "page_id long, url string, html string")
    folder = _store.new_path(spark, "pages")
    packages = warc_zip.write(pages, folder, package_bytes=200)
    got = warc_zip.read(packages, folder, payloads=True)
    assert got.rdd.getNumPartitions() == packages.count() > 1  # one task does not read all
    assert got.select("package").distinct().count() > 1
    held = {bytes(r.payload).decode() for r in got.collect() if r.payload is not None}
    assert held == {h or "" for _, _, h in _page_rows()}


def test_small_payloads_are_all_responses(spark):
    pages = spark.createDataFrame(_page_rows(), "page_id long, url string, html string")
    folder = _store.new_path(spark, "pages")
    kinds = {(r.page_id, r.record_type) for r in warc_zip.read(warc_zip.write(pages, folder, least=5), folder).collect()}
    assert (4, "response") in kinds and (1, "revisit") in kinds


def test_directory_against_another_reader():
    data = warc_zip.package([b"abc", b"defg"], ["k d {}\n"])
    read = lambda at, n: data[at : at + n]
    entries = warc_zip.directory(read, len(data))
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert set(entries) == set(z.namelist())
        for name in entries:
            at, n = warc_zip.member(read, entries[name])
            assert data[at : at + n] == z.read(name)
    with pytest.raises(ValueError):
        warc_zip.directory(lambda at, n: bytes(n), 100)


def test_zip64_directory():
    """More members than the old fields can count."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for i in range(66_000):
            z.writestr(zipfile.ZipInfo(f"m{i}"), b"x" if i else b"first")
    data = out.getvalue()
    entries = warc_zip.directory(lambda at, n: data[at : at + n], len(data))
    assert len(entries) == 66_000 and warc_zip.member(lambda at, n: data[at : at + n], entries["m0"])[1] == 5


def test_compressed_members_are_refused():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", b"x" * 100)
    data = out.getvalue()
    read = lambda at, n: data[at : at + n]
    with pytest.raises(ValueError):
        warc_zip.member(read, warc_zip.directory(read, len(data))["a"])


def test_damage_is_seen():
    r = warc_zip.record(1, "u", b"payload", None)
    assert warc_zip.parse_record(r)["payload"] == b"payload"
    with pytest.raises(ValueError):
        warc_zip.parse_record(r.replace(b"payload\r\n\r\n", b"paYload\r\n\r\n"))


def _foreign(gzipped: bool, index: str) -> bytes:
    """A package of another writer: two archives, headers in other case, a record of the crawl, one without HTTP, one without a length in its head."""
    import gzip

    def warc(kind, rid, body, **more):
        head = [f"warc-type: {kind}", f"WARC-Record-ID: <urn:uuid:{rid}>", *(f"{k.replace('_', '-')}:  {v}" for k, v in more.items()), f"content-length: {len(body)}"]
        return "WARC/1.0\r\n".encode() + "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"

    parts = {
        "archive/one.warc": [warc("warcinfo", 1, b"software: other\r\n"), warc("response", 2, b"HTTP/1.1 200 OK\r\n\r\nbody", WARC_Target_URI="http://a/"), warc("resource", 3, b"plain text")],
        "archive/two.warc": [warc("response", 4, b"HTTP/1.0 200 OK\r\ncontent-LENGTH: 3\r\n\r\nabc", WARC_Payload_Digest="sha1:" + warc_zip.payload_digest(b"abc")), warc("revisit", 5, b"", WARC_Payload_Digest="sha256:00")],
    }
    out, lines = io.BytesIO(), []
    with zipfile.ZipFile(out, "w") as z:
        for name, records in parts.items():
            name, at, data = name + ".gz" * gzipped, 0, b""
            for r in records:
                one = gzip.compress(r) if gzipped else r
                short = name.rpartition("/")[2]
                lines.append(f'com,a)/ 20200101000000 {{"url": "http://a/", "offset": "{at}", "length": "{len(one)}", "filename": "{short}"}}' if index == "json" else f"com,a)/ 20200101000000 http://a/ text/html 200 AAAA - - {len(one)} {at} {short}")
                data, at = data + one, at + len(one)
            z.writestr(name, data)
        if index:
            text = "\n".join([" CDX N b a m s k r M S V g", "no line of an index", *lines]).encode()
            z.writestr("indexes/index.cdx.gz" if index == "json" else "indexes/index.cdx", gzip.compress(text) if index == "json" else text)
        z.writestr("pages/pages.jsonl", "{}")
    return out.getvalue()


@pytest.mark.parametrize("gzipped", [True, False])
@pytest.mark.parametrize("index", ["json", "classic", ""])
def test_packages_of_other_writers(spark, tmp_path, gzipped, index):
    (tmp_path / "other.wacz").write_bytes(_foreign(gzipped, index))
    got = warc_zip.read(spark.createDataFrame([("other.wacz",)], "package string"), f"file://{tmp_path}", payloads=True).collect()
    assert sorted((r.record_type, r.payload_bytes, bytes(r.payload) if r.payload is not None else None) for r in got if r.record_type != "revisit") == [("resource", 10, b"plain text"), ("response", 3, b"abc"), ("response", 4, b"body"), ("warcinfo", 17, b"software: other\r\n")]
    (again,) = [r for r in got if r.record_type == "revisit"]
    assert (again.page_id, again.refers_to, again.payload) == (None, None, None)


def test_member_checksums():
    data = bytearray(warc_zip.package([b"WARC/1.1 abc"], []))
    get = lambda at, n: bytes(data[at : at + n])
    assert len(list(warc_zip.located(get, len(data), checked=True))) == 1
    data[data.index(b"abc")] = 0x41
    with pytest.raises(ValueError):
        list(warc_zip.located(get, len(data), checked=True))


def test_old_versions_stay_readable(spark):
    """A reader of a replaced version keeps its files until they are expired; pieces are shared between versions."""
    df = spark.range(400).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    s = compaction.ShardSet(spark, _store.new_path(spark, "shards"), df.schema, target=1 << 20)
    for k in range(5):
        s.append(df.where(df["doc_id"] % 5 == k).coalesce(1))
    old = s.version()
    new = s.compact()
    assert new > old and s.read(old).count() == s.read(new).count() == 400
    assert s.expire(keep=1, grace=3600) == [] and s.read(old).count() == 400
    assert len(s.expire(keep=1, grace=-60)) == 5 and s.read(new).count() == 400 and len(s.shards(new)) == 1


def test_compaction_keeps_every_row(odd, plain):
    got = compaction.digest(odd, target=1 << 16)
    rows = got.collect()
    md5 = lambda t: None if t is None else hashlib.md5(t.encode()).hexdigest()
    assert Counter((r.doc_id, r.text_md5) for r in rows) == Counter((i, md5(t)) for i, t, _ in plain)
    assert len({r.version for r in rows}) == 1
    assert compaction.digest(odd.limit(0)).count() == 0


def test_versions_and_lost_races(spark):
    df = spark.range(1000).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 512).alias("text"))
    s = compaction.ShardSet(spark, _store.new_path(spark, "shards"), df.schema, target=1 << 20)
    for k in range(3):
        assert s.append(df.where(df["doc_id"] % 3 == k).coalesce(1)) == k + 1
    assert s.read().count() == 1000 and s.read(1).count() == 334
    before = s.shards()
    with pytest.raises(Exception, match="exist"):
        s.commit(before, 1)
    assert s.compact() == 3  # three shards are too few
    s.append(df.limit(0))
    s.append(df.where("doc_id < 10").coalesce(1))
    assert s.compact() > 5
    assert s.read().count() == 1010 and len(s.shards()) < 5
    assert not {x.path for x in before} & {x.path for x in s.shards()}


def test_plan_fills_bins():
    shard = lambda i, n: compaction.Shard(f"p{i:03d}", n, compaction.tier_of(n), i)
    small = [shard(i, 1 << 20) for i in range(10)]
    bins = compaction.plan(small, target=4 << 20)
    assert [len(b) for b in bins] == [4, 4, 2]
    assert compaction.plan(small[:3], target=4 << 20) == []
    assert compaction.plan([shard(i, 3 << 20) for i in range(9)], target=4 << 20) == []


def test_pipeline(spark, odd, labels, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    sf = str(tmp_path)
    item = "A benchmark passage about the seven silver bridges that cross the quiet river near the old copper market in winter"
    leak = spark.createDataFrame([(200, item + " " + " ".join(f"tail{i} word{i * 7}" for i in range(60)), "en", "s0")], "doc_id long, text string, lang string, source string")
    docs = odd.select("doc_id", "text", "lang", "source").union(leak)
    docs.write.parquet(f"{sf}/documents.parquet")
    labels.write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    got = pipeline.run(spark, sf).collect()
    held = {r.doc_id for r in got}
    assert not held & {100, 101, 103, 104, 106, 107, 108, 200}  # copies, too short, repeated, leaked
    assert held <= {r.doc_id for r in docs.collect()} and len(got) >= 20
    stage = pipeline.rules(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    assert stage.columns == docs.columns


def test_the_pipeline_leaves_little_in_the_executors(spark, monkeypatch):
    """Executors keep their Python workers and what these hold: a manifest's rows start none, and tables for pieces of texts are small."""
    import numpy as np
    import pyarrow as pa

    from heronlake.llm import _words as W

    s = compaction.load(spark.range(50).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text")))
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", lambda *_: pytest.fail("rows by Python workers"))
    live = s.shards()
    assert [tuple(r) for r in s.table().orderBy("shard").collect()] == [(i, x.path.rpartition("/")[2], x.size, x.tier, s.version()) for i, x in enumerate(live)]
    monkeypatch.setattr(W, "_powers", [])
    texts = pa.array(["one two three " * 300] * 400)
    parts = list(W.slices(pa.record_batch([texts], names=["text"]), "text", W.FEW_BYTES))
    sets = [np.concatenate([W.words(p.column("text")).count() for p in parts]), W.words(texts).count()]
    assert len(parts) > 4 and (sets[0] == sets[1]).all() and (sets[0] == 900).all()
    W._powers.clear()
    W.words(parts[0].column("text"))
    assert sum(t.nbytes for t in W._powers) < 8 << 20

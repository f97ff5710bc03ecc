"""Ids, codecs, the routing table, writes, serving, sources and state against plain versions."""

from __future__ import annotations

import datetime as dt
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from heronlake.functions import fts, ids, text
from heronlake.operators import dml, lookup, routing, serve
from heronlake.schemas import SCHEMAS
from heronlake.sources import config, messages, scrape
from heronlake.sources.tables import TableStore
from heronlake.streaming import state


def _ids(n, seed=1):
    r = random.Random(seed)
    return [f"{r.getrandbits(160):040x}" for _ in range(n)]


def test_distances(spark):
    a, b = _ids(50), _ids(50, 2)
    a[0] = b[0]
    rows = spark.createDataFrame(list(zip(a, b, strict=True)), "a string, b string")
    for r in rows.select("a", "b", ids.xor_hex(F.col("a"), F.col("b")).alias("x"), ids.common_prefix(F.col("a"), F.col("b")).alias("p")).collect():
        x = int(r.a, 16) ^ int(r.b, 16)
        assert r.x == f"{x:040x}"
        assert r.p == 160 - x.bit_length()


def test_node_id_vectors(spark):
    """Published addresses with their first 21 bits and last digits."""
    known = [("124.31.75.21", 1, "5fbfbf"), ("21.75.31.124", 86, "5a3ce9"), ("65.23.51.170", 22, "a5d432"), ("84.124.73.14", 65, "1b0321"), ("43.213.53.83", 90, "e56f6c")]
    rows = spark.createDataFrame([(ip, r, "00" * 19 + f"{r:02x}") for ip, r, _ in known], "ip string, r int, rest string")
    got = rows.select("ip", ids.derive(F.col("ip"), F.col("r"), F.col("rest")).alias("id")).collect()
    for r, (_, _, head) in zip(got, known, strict=True):
        assert int(r.id[:6], 16) >> 3 == int(head, 16) >> 3
    made = spark.createDataFrame(got)
    assert all(r[0] for r in made.select(ids.valid_for_ip(F.col("id"), F.col("ip"))).collect())
    assert not made.select(ids.valid_for_ip(F.col("id"), F.lit("1.2.3.4"))).first()[0]
    assert not made.select(ids.valid_for_ip(F.col("id"), F.lit("::1"))).first()[0]


def test_codecs(spark):
    rows = spark.createDataFrame([(i, "10.0.0.7", 6881) for i in _ids(3)], "id string, ip string, port int")
    packed = rows.agg(F.unhex(F.array_join(F.collect_list(F.hex(ids.encode_node(F.col("id"), F.col("ip"), F.col("port")))), "")).alias("b"))
    got = packed.select(ids.decode_nodes(F.col("b")).alias("n"), ids.decode_nodes(F.substring("b", 1, 30)).alias("bad")).first()
    assert [(n.id, n.addr.ip, n.addr.port) for n in got.n] == [(i, "10.0.0.7", 6881) for i in _ids(3)]
    assert got.bad is None
    peers = spark.createDataFrame([([b"\x01\x02\x03\x04\x1a\xe1"],), ([b"\x01\x02\x03\x04\x1a\xe1", b"x"],)], "v array<binary>").select(ids.decode_peers(F.col("v"))).collect()
    assert [(p.ip, p.port) for p in peers[0][0]] == [("1.2.3.4", 6881)] and peers[1][0] is None
    assert spark.createDataFrame([(b"a" * 45,)], "b binary").select(F.size(ids.split_samples(F.col("b")))).first()[0] == 2


def test_long_node_lists_are_read_once(spark):
    """A column in a record's expression is copied from its row for each record."""
    assert str(ids.decode_nodes(F.col("wire_nodes"))).count("wire_nodes") == 1
    rows = spark.range(20_000).select(F.sha1(F.col("id").cast("string").cast("binary")).alias("n"), (F.col("id") % 65_536).alias("port"))
    packed = rows.agg(F.unhex(F.array_join(F.collect_list(F.hex(ids.encode_node(F.col("n"), F.lit("10.0.0.7"), F.col("port")))), "")).alias("nodes"))
    got = packed.select(F.explode(ids.decode_nodes(F.col("nodes"))).alias("r")).select(F.col("r.id").alias("n"), F.col("r.addr.port").cast("long").alias("port"))
    assert got.count() == 20_000 and got.exceptAll(rows).isEmpty()


def test_nearest(spark):
    nodes, targets = _ids(300), _ids(4, 9)
    n = spark.createDataFrame([(x, i % 4) for i, x in enumerate(nodes)], "node_id string, failure_count int")
    got = routing.nearest(spark.createDataFrame([(t,) for t in targets], "target string"), n, 5).collect()
    for t in targets:
        good = [x for i, x in enumerate(nodes) if i % 4 < 3]
        assert [r.node_id for r in sorted((r for r in got if r.target == t), key=lambda r: r["rank"])] == sorted(good, key=lambda x: int(x, 16) ^ int(t, 16))[:5]


def test_scaled_distances():
    assert routing.scaled("80" + "00" * 19, 0.5) == "40" + "00" * 19
    assert routing.scaled("01" + "00" * 19, 0.5) == "0080" + "00" * 18
    assert routing.scaled("ff" * 20, 1.0) == "ff" * 20


def test_routing_table():
    own = "00" * 20
    t = routing.RoutingTable(0, size=2, bad=2)
    far = [f"{0xF0 + i:02x}" + "00" * 19 for i in range(6)]
    assert [t.insert(f, "a", i) for i, f in enumerate(far[:2])] == ["inserted", "inserted"]
    assert t.insert(far[2], "a", 3) == "cached"
    assert t.insert(far[3], "a", 3) == "cached" and t.insert(far[4], "a", 3) == "dropped"
    assert t.insert(far[0], "b", 4) == "updated"
    assert t.failure(far[0], 5) == "failed" and t.failure(far[0], 6) == "evicted"
    assert [x["id"] for x in t.bucket(int(far[1], 16)).nodes] == [far[1], far[2]]
    assert t.insert(own, "a", 7) == "inserted" and len(t.buckets) > 1


def test_lookup_reaches_the_nearest(spark):
    nodes = _ids(200, 5)
    links = [(a, b) for i, a in enumerate(nodes) for b in (nodes[(i + 1) % 200], nodes[(7 * i + 3) % 200], nodes[(31 * i + 5) % 200], nodes[(i * i + 11) % 200])]
    target = nodes[77]
    got = lookup.iterate(spark.createDataFrame([(target, nodes[0])], "target string, node_id string"), spark.createDataFrame(links, "node_id string, found_id string")).collect()
    held, asked, key = {nodes[0]}, set(), lambda x: int(x, 16) ^ int(target, 16)
    out: dict[str, list[str]] = {}
    for a, b in links:
        out.setdefault(a, []).append(b)
    while True:
        near = sorted(held, key=key)[:8]
        ask = [x for x in near if x not in asked][:3]
        if not ask:
            break
        asked |= set(ask)
        held = set(sorted(set(near) | {b for a in ask for b in out[a]}, key=key)[:8])
        asked &= held
    assert {(r.node_id, r.asked) for r in got} == {(x, x in asked) for x in held}


def test_writes(spark):
    t = spark.createDataFrame([("a", "pending"), ("b", "active")], "infohash string, state string")
    new = spark.createDataFrame([("b", "x"), ("c", "y"), ("c", "z")], "infohash string, state string")
    assert sorted(map(tuple, dml.insert_new(new, t, order="state").collect())) == [("a", "pending"), ("b", "active"), ("c", "y")]
    with pytest.raises(ValueError):
        dml.set_state(t, "a", "nonsense")
    files = spark.createDataFrame([("a", ["x.MKV", "d.d/y", "z.mp4"], [1, 2, 3])], "infohash string, paths array<string>, sizes array<long>")
    assert [tuple(r)[1:] for r in dml.explode_files(files).collect()] == [("x.MKV", 1, ".MKV", False), ("d.d/y", 2, None, False), ("z.mp4", 3, ".mp4", True)]
    links = dml.upsert_links(spark.createDataFrame([("a", 1, dt.datetime(2020, 1, 1), False)], "infohash string, tracker_id long, last_scrape timestamp, is_active boolean"), spark.createDataFrame([("a", 1, dt.datetime(2021, 1, 1)), ("b", 1, dt.datetime(2021, 1, 1))], "infohash string, tracker_id long, last_scrape timestamp"))
    assert sorted((r.infohash, r.last_scrape.year, r.is_active) for r in links.collect()) == [("a", 2021, False), ("b", 2021, True)]


def test_table_store(spark, tmp_path):
    store = TableStore(spark, f"file://{tmp_path}", {"genres": SCHEMAS["genres"]})
    assert store.read("genres").count() == 0
    store.write("genres", spark.createDataFrame([(1, 2, "movie", "Drama")], SCHEMAS["genres"]))
    store.write("genres", store.read("genres").unionByName(spark.createDataFrame([(2, 2, "tv", "Drama")], SCHEMAS["genres"])))
    assert store.version("genres") == 2 and store.read("genres").count() == 2 and store.read("genres", 1).count() == 1


def test_item_markup(spark):
    row = ("Test.Movie.2024.1080p.BluRay.x264-GROUP", "bddb5ff04822e617d62c503e9087a4ec2b318862", 19978580639, dt.datetime(2026, 4, 9, 16, 57, 57), 2, 0, "movie", "1080p", "x264", "BluRay", "GROUP", None, 0)
    df = spark.createDataFrame([row], "name string, infohash string, total_size long, first_seen timestamp, seeders long, leechers long, content_type string, quality string, encoding string, source string, release_group string, imdb_id string, season int")
    got = serve.items(df).first()["item"]
    assert got.startswith('<item><title>Test.Movie.2024.1080p.BluRay.x264-GROUP</title><guid isPermaLink="false">bddb5ff04822e617d62c503e9087a4ec2b318862</guid><link>magnet:?xt=urn:btih:bddb5ff04822e617d62c503e9087a4ec2b318862&amp;dn=')
    assert '<pubDate>Thu, 09 Apr 2026 16:57:57 +0000</pubDate><torznab:attr name="seeders" value="2"></torznab:attr>' in got
    assert got.endswith('<torznab:attr name="resolution" value="1080p"></torznab:attr><torznab:attr name="encoding" value="x264"></torznab:attr><torznab:attr name="source" value="BluRay"></torznab:attr><torznab:attr name="releasegroup" value="GROUP"></torznab:attr></item>')


def test_requests(spark):
    r = serve.parse({"t": "tvsearch", "season": "x", "limit": "-3", "cat": "2000,,a,5000", "q": ""})
    assert (r.season, r.limit, r.categories, r.q) == (None, -3, (2000, 5000), None)
    assert 'code="202"' in serve.handle({"t": "book"}, {}) and "<caps>" in serve.handle({"t": "caps"}, {}) and 'code="300"' in serve.handle({"t": "search"}, {})


def test_api(spark):
    t = spark.createDataFrame([("a", "n", "active", "tv", dt.datetime(2020, 1, 1))], "infohash string, name string, state string, content_type string, created_at timestamp")
    api = serve.Api({"torrents": t})
    assert api.list(limit=0)[0] == 400 and len(api.list()[1]) == 1 and api.get("zz")[0] == 404
    assert api.patch("a", "bad")[0] == 400 and api.patch("a", "dead")[0] == 204 and '"state":"dead"' in api.get("a")[1]
    assert api.delete("a")[0] == 204 and api.get("a")[0] == 404


def test_escapes(spark):
    df = spark.createDataFrame([("a b*c~d&é/",)], "s string")
    assert df.select(text.query_escape(F.col("s"))).first()[0] == "a+b%2Ac~d%26%C3%A9%2F"
    assert spark.createDataFrame([(b"ab\xffc",)], "b binary").select(text.clean_utf8(F.col("b"))).first()[0] == "abc"


def test_stems():
    known = {"caresses": "caress", "ponies": "poni", "ties": "tie", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "hopping": "hop", "hoping": "hope", "falling": "fall", "relational": "relat", "conditional": "condit",
             "sensibiliti": "sensibl", "hopeful": "hope", "goodness": "good", "adjustment": "adjust", "adoption": "adopt", "rate": "rate", "cease": "ceas", "controll": "control", "skies": "sky", "generously": "generous", "knightly": "knight", "happy": "happi", "cry": "cri", "by": "by", "say": "say"}
    assert {w: fts.stem(w) for w in known} == known


def test_tracker_reply(spark):
    reply = bytes(8) + b"".join(n.to_bytes(4, "big") for n in (5, 6, 7, 8, 9, 10)) + b"\0"
    got = scrape.decode_reply(spark.createDataFrame([(["a", "b", "c"], reply)], "hashes array<string>, reply binary")).collect()
    assert [tuple(r) for r in got] == [("a", 5, 6, 7), ("b", 8, 9, 10)]


def test_metadata(spark):
    info = b"d5:filesld6:lengthi5e4:pathl1:d5:a.mkveed6:lengthi7e4:pathl5:b.srteee4:name4:Showe"
    single = b"d6:lengthi9e4:name5:x.mkve"
    rows = [(hashlib.sha1(b).hexdigest(), b) for b in (info, single, b"junk")] + [("0" * 40, info)]
    got = {r.name: ([(f.path, f.size) for f in r.files], r.total_size) for r in messages.metadata(spark.createDataFrame(rows, "infohash string, info binary")).collect()}
    assert got == {"Show": ([("d/a.mkv", 5), ("b.srt", 7)], 12), "x.mkv": ([("x.mkv", 9)], 9)}


def test_config():
    c = config.load({"workers": 3}, {"HERONLAKE_MAX_PEERS": "7", "HERONLAKE_EXTENSION_FILTER": "true"})
    assert (c.workers, c.max_peers, c.extension_filter) == (3, 7, True)
    with pytest.raises(ValueError):
        config.load({"node_id": "x", "external_ip_file": "y"}, {})


def test_token_bucket():
    ok, (tokens, _) = state.bucket_decisions([0, 0, 0, 1, 1], 1.0, 2)
    assert ok == [True, True, False, True, False] and tokens == 0


def _log(spark, n=400):
    r, t0 = random.Random(3), dt.datetime(2024, 1, 1)
    return [(f"k{r.randrange(6)}", i, t0 + dt.timedelta(seconds=60 * i + r.randrange(50))) for i in range(n)]


def test_rotating_dedup_batch_and_stream(spark, tmp_path):
    log = _log(spark)
    last, expect = {}, set()
    for k, i, t in log:
        w = int(t.replace(tzinfo=dt.timezone.utc).timestamp() // 1800)
        if k not in last or w - last[k] >= 2:
            expect.add((k, i))
            last[k] = w
    df = spark.createDataFrame(log, "infohash string, event_id long, seen_at timestamp")
    assert {(r.infohash, r.event_id) for r in state.rotating_dedup(df, 1800).collect()} == expect
    for a in range(0, len(log), 150):
        spark.createDataFrame(log[a : a + 150], df.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = state.rotating_dedup_stream(stream, 1800).writeStream.format("memory").queryName("deduped").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.infohash, r.event_id) for r in spark.table("deduped").collect()} == expect


def test_lookups_run_to_their_end(spark):
    import __spark_entry__

    got = __spark_entry__.queries()["iterative_lookup"](spark, "/root/testdata/sf0.001").groupBy("target").agg(F.count("*").alias("n"), F.count_if("asked").alias("asked")).collect()
    assert got and all(r.n == r.asked for r in got)

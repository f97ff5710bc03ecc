"""Stores, limits, crawling and hostile messages, against plain versions and stated cases."""

from __future__ import annotations

import datetime as dt
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from heronlake.functions import text
from heronlake.operators import bootstrap, lookup, routing, serve
from heronlake.schemas import SCHEMAS
from heronlake.sources import messages
from heronlake.sources.gateway import Gateway
from heronlake.sources.tables import TableStore
from heronlake.streaming import ingest, state

T0 = dt.datetime(2024, 1, 1)


def _at(s: float):
    return F.lit((T0 + dt.timedelta(seconds=s)).isoformat(sep=" ")).cast("timestamp")


def _log(spark, rows):
    return spark.createDataFrame([(h, ip, 1, T0 + dt.timedelta(seconds=s), i) for i, (h, ip, s) in enumerate(rows)], "infohash string, ip string, port int, seen_at timestamp, event_id long")


def _live(df, *args, **more):
    return sorted((r.infohash, r.ip) for r in state.live_peers(df, *args, **more).collect())


def test_expired_peers_make_room(spark):
    log = _log(spark, [("A", "p0", 0), ("A", "p1", 1), ("A", "p2", 1000)])
    assert _live(log, _at(1001), 100, 2, 10) == [("A", "p2")]
    assert _live(log, _at(2), 100, 2, 10) == [("A", "p0"), ("A", "p1")]
    assert _live(log, _at(1100), 100, 2, 10) == []


def test_a_hash_that_comes_again_is_new(spark):
    log = _log(spark, [("A", "p", 0), ("B", "p", 1), ("C", "p", 2), ("A", "p", 3)])
    assert _live(log, _at(4), 100, 5, 2) == [("A", "p"), ("C", "p")]


def test_stores_against_plain_lists(spark):
    r = random.Random(3)
    rows = sorted(((r.choice("ABCDEFGH"), f"p{r.randrange(6)}", r.randrange(4000)) for _ in range(600)), key=lambda x: x[2])
    held: list[tuple[str, list]] = []
    for h, p, s in rows:
        held = [(x, left) for x, peers in held if (left := [(q, t) for q, t in peers if t > s - 300])]
        mine = next((peers for x, peers in held if x == h), None)
        if mine is None:
            held = [*(held[1:] if len(held) >= 4 else held), (h, [(p, s)])]
        elif any(q == p for q, _ in mine):
            mine[:] = [(q, s if q == p else t) for q, t in mine]
        elif len(mine) < 3:
            mine.append((p, s))
    log = _log(spark, rows)
    expect = sorted((h, p) for h, peers in held for p, t in peers if t > 4000 - 300)
    assert _live(log, _at(4000), 300, 3, 4) == expect
    both = log.withColumn("own", F.lit("x")).unionByName(log.withColumn("own", F.lit("y")))
    assert _live(both, _at(4000), 300, 3, 4, store="own") == sorted(expect * 2)
    assert _live(log.limit(0), _at(4000), 300, 3, 4) == []


def test_a_store_without_a_cap_on_hashes_lets_none_go(spark):
    r = random.Random(5)
    rows = sorted(((f"h{r.randrange(40)}", f"p{r.randrange(6)}", r.randrange(4000)) for _ in range(600)), key=lambda x: x[2])
    log = _log(spark, rows)
    for peers in (2, 10):
        assert _live(log, _at(4000), 300, peers, None) == _live(log, _at(4000), 300, peers, 1000)
    both = log.withColumn("own", F.lit("x")).unionByName(log.withColumn("own", F.lit("y")))
    assert _live(both, _at(4000), 300, 3, None, store="own") == sorted(_live(log, _at(4000), 300, 3, 1000) * 2)


def _differing(spark, name: str, folder, **tables) -> tuple[int, int]:
    """Rows of a query that its SQL has not, and the other way round, on these tables."""
    import __spark_entry__ as entry

    con = pytest.importorskip("duckdb").connect()
    for table, df in tables.items():
        df.write.parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    entry.queries()[name](spark, str(folder)).write.parquet(f"{folder}/got")
    con.execute(f"CREATE TABLE b AS {entry.oracle_sql()[name]}")
    cols = ", ".join(r[0] for r in con.execute("DESCRIBE b").fetchall())
    con.execute(f"CREATE TABLE a AS SELECT {cols} FROM '{folder}/got/*.parquet'")
    return tuple(con.execute(f"SELECT count(*) FROM (SELECT * FROM {x} EXCEPT ALL SELECT * FROM {y})").fetchall()[0][0] for x, y in ("ab", "ba"))


def test_peers_of_more_hashes_than_a_store_of_ten_thousand(spark, tmp_path):
    events = spark.range(24_000).select(F.col("id").alias("event_id"), (F.timestamp_seconds(F.col("id") + 1_700_000_000)).cast("timestamp_ntz").alias("ts"), (F.col("id") % 12_000).alias("user_id"))
    customer = spark.range(40).select(F.col("id").alias("c_custkey"))
    assert _differing(spark, "get_peers_replies", tmp_path, events=events, customer=customer) == (0, 0)


def test_hosts_of_more_suppliers_than_ports(spark, tmp_path):
    supplier = spark.createDataFrame([(k,) for k in (0, 1, 999, 49_999, 50_000, 59_535, 59_536, 59_999, 64_000, 130_000)], "s_suppkey long")
    assert _differing(spark, "bootstrap_hosts", tmp_path, supplier=supplier) == (0, 0)
    entries = spark.createDataFrame([("a:65535, b:65536,c:70000",)], "hosts string")
    assert [tuple(r) for r in bootstrap.host_list(entries).collect()] == [("a", 65_535)]  # what is no port is still skipped


def test_limits_by_idle_time_and_room(spark):
    rows = [("a", 0, 1), ("a", 0, 2), ("b", 1, 3), ("c", 1, 4), ("a", 2, 5), ("c", 60, 6), ("", 61, 7), (None, 62, 8)]
    df = spark.createDataFrame([(ip, T0 + dt.timedelta(seconds=s), i) for ip, s, i in rows], "ip string, at timestamp, seq long")
    got = {r.seq: r.allowed for r in state.rate_limited(df, 0.001, 1, idle_seconds=30.0, most_keys=2).collect()}
    assert got == {1: True, 2: False, 3: True, 4: False, 5: False, 6: True, 7: False, 8: False}
    apart = {r.seq: r.allowed for r in state.rate_limited(df, 0.001, 1).collect()}
    assert apart == {1: True, 2: False, 3: True, 4: True, 5: False, 6: False, 7: False, 8: False}


def test_peer_stream(spark, tmp_path):
    """The stream's last count of each hash is the batch's, while nothing expires."""
    r = random.Random(5)
    log = _log(spark, [(r.choice("AB"), f"p{r.randrange(9)}", s) for s in range(60)])
    log.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "in"))
    q = state.peer_store_stream(stream, 4, 10_000).writeStream.format("memory").queryName("peers").option("checkpointLocation", str(tmp_path / "cp")).outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {x.infohash: x.n_live for x in spark.table("peers").collect()}
    assert got == {h: sum(a == h for a, _ in _live(log, _at(60), 10_000, 4, 10)) for h in "AB"}


def test_peers_of_displaced_nodes(spark):
    """What far nodes answered counts, though nearer ones take their places."""
    far, near = [f"f{i}" + "0" * 38 for i in range(3)], [f"0{i}" + "0" * 38 for i in range(3)]
    starts = spark.createDataFrame([("0" * 40, n) for n in far], "target string, node_id string")
    answers = spark.createDataFrame([(f, n) for f in far for n in near], "node_id string, found_id string")
    peers = spark.createDataFrame([("0" * 40, f, "10.0.0.1", 1) for f in far], "target string, node_id string, ip string, port int")
    assert lookup.peers_found(starts, answers, peers, k=3, alpha=3, rounds=3).count() == 3


def test_hostile_messages(spark):
    deep = b"l" * 100_000 + b"e" * 100_000
    bad = [deep, b"d4:namei5ee", b"d4:name1:a6:lengthi-1ee", b"d4:name1:a6:lengthi99999999999999999999ee", b"d5:filesi1e4:name1:ae", b"d5:filesld6:lengthi1e4:pathi1eee4:name1:ae", b"i5e", b"d", b"5:ab", b"-1:a", b"", b"di1ei2ee", b"d4:name1:a5:filesle"]
    rows = [(hashlib.sha1(b).hexdigest(), b) for b in [*bad, b"d6:lengthi9e4:name5:x.mkve"]]
    assert [r.name for r in messages.metadata(spark.createDataFrame(rows, "infohash string, info binary")).collect()] == ["x.mkv"]
    assert messages.bdecode(deep)[1] == len(deep)
    assert messages.bdecode(b"d1:ali1e2:xye1:bdee") == ({b"a": [1, b"xy"], b"b": {}}, 19)


def _fetched(spark, rows):
    return spark.createDataFrame([(h, i, 0, True, name, 1 << 30, [(p, 5) for p in paths]) for i, (h, name, paths) in enumerate(rows)], "infohash string, seq long, peer_rank int, ok boolean, name string, total_size long, files array<struct<path:string,size:long>>")


def test_long_names_are_refused_whole(spark):
    rows = _fetched(spark, [("a", "Film.2001.720p" + "x" * 500, ["a.mkv"]), ("b", "Film.2002.720p", ["b.mkv"]), ("c", "x" * 500, []), ("d", "Bad�Name.2003.720p", ["c�.mkv"])])
    out = ingest.ingest(rows, spark.createDataFrame([], SCHEMAS["torrents"]), _at(0))
    assert {r.infohash: r.name for r in out["torrents"].collect()} == {"b": "Film.2002.720p", "c": "x" * 500, "d": "BadName.2003.720p"}
    assert [tuple(r) for r in out["refused"].collect()] == [("a", "name_length")]
    assert {r.path for r in out["torrent_files"].collect()} == {"b.mkv", "c.mkv"}


def test_ingest_stream_repeats_add_nothing(spark, tmp_path):
    store = TableStore(spark, f"file://{tmp_path}/store", SCHEMAS)
    rows = _fetched(spark, [("a", "Film.2001.720p", ["a.mkv"]), ("b", "Show.S01E02.720p", ["b.mkv", "b.srt"])])
    for k in range(2):  # the same fetches twice, in two files
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        ingest.start(stream, store, str(tmp_path / "cp"), _at(0)).awaitTermination()
        assert (store.read("torrents").count(), store.read("torrent_files").count()) == (2, 3)
    assert {r.content_type for r in store.read("torrents").collect()} == {"movie", "tv"}


def test_message_stream(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"t": "1", "y": "q", "q": "ping", "ip": "10.0.0.1"}\nnot json\n{"t": "2"}\n')
    q = ingest.message_stream(spark, str(tmp_path), most_files=1).select("t", "y").writeStream.format("memory").queryName("messages").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [tuple(r) for r in spark.table("messages").collect()] == [("1", "q")]


def test_stores_forget_old_data(spark, tmp_path):
    store = TableStore(spark, f"file://{tmp_path}", {"genres": SCHEMAS["genres"]})
    for i in range(5):
        store.write("genres", spark.createDataFrame([(i, i, "movie", "x")], SCHEMAS["genres"]))
    assert len(list((tmp_path / "genres").glob("data-*"))) == 2
    assert store.read("genres").first().id == 4 and store.read("genres", 4).first().id == 3


def test_appends_write_their_own_rows(spark, tmp_path):
    store = TableStore(spark, f"file://{tmp_path}", {"genres": SCHEMAS["genres"]}, most_pieces=3)
    folders = lambda: {p.name for p in (tmp_path / "genres").glob("data-*")}
    ids_of = lambda v=None: sorted(r.id for r in store.read("genres", v).collect())
    rows = lambda *k: spark.createDataFrame([(i, i, "movie", "x") for i in k], SCHEMAS["genres"])
    store.append({"genres": rows(0)})
    first = folders()
    store.append({"genres": rows(1)})
    store.append({"genres": rows()})  # nothing new
    assert first < folders() and len(folders()) == 3 and ids_of() == [0, 1]
    store.append({"genres": rows(2)})  # beyond the most pieces: one whole folder
    assert ids_of() == [0, 1, 2] and ids_of(3) == [0, 1] and len(folders()) == 4
    store.append({"genres": rows(3)})
    assert ids_of() == [0, 1, 2, 3] and ids_of(4) == [0, 1, 2] and len(folders()) == 2 and not first & folders()


def test_gateway_and_stored_patches(spark, tmp_path):
    store = TableStore(spark, f"file://{tmp_path}", SCHEMAS)
    cols = "infohash string, name string, state string, content_type string, created_at timestamp"
    start = spark.createDataFrame([(h, h, "active", "tv", T0) for h in "abc"], cols)
    store.write("torrents", start.select(*(F.col(f.name) if f.name in start.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in SCHEMAS["torrents"].fields)))
    store.write("torrent_files", spark.createDataFrame([], SCHEMAS["torrent_files"]))
    api = serve.Api({t: store.read(t) for t in ("torrents", "torrent_files")}, store)
    assert api.patch("a", "dead")[0] == 204 and api.patch("zz", "dead")[0] == 404 and api.delete("b")[0] == 204
    g = Gateway(spark, store)
    assert {(r.infohash, r.state) for r in g.query("SELECT infohash, state FROM {torrents} WHERE :state IS NULL OR state = :state", state=None).collect()} == {("a", "dead"), ("c", "active")}
    assert g.execute({"torrents": "SELECT * FROM {torrents} WHERE infohash <> :gone"}, gone="a") == {"torrents": 4}
    assert [len(p) for p in serve.Api({"torrents": start}).pages(limit=2)] == [2, 1]
    assert api.health()[0] == 200


def test_documents_are_indented():
    lines = serve.indented('<?xml version="1.0"?>\n<rss><channel><title>a &lt; b</title><item><x y="1"></x></item></channel></rss>').splitlines()
    assert lines == ['<?xml version="1.0"?>', "<rss>", "  <channel>", "    <title>a &lt; b</title>", "    <item>", '      <x y="1"></x>', "    </item>", "  </channel>", "</rss>"]


def test_crawl_schedule(spark):
    ready = spark.createDataFrame([(f"{i:040x}", f"{i:040x}", 0.0) for i in (1, 2, 9)], "node_id string, dist string, yield_factor double")
    cooling = ready.limit(0).unionByName(spark.createDataFrame([(f"{i:040x}", f"{i:040x}", 0.0) for i in (3, 4)], ready.schema)).withColumn("next_allowed", F.when(F.col("node_id").endswith("3"), _at(0)).otherwise(_at(99)))
    batch, rest, still = lookup.schedule(ready, cooling, _at(10), 3)
    assert [sorted(int(r.node_id, 16) for r in x.collect()) for x in (batch, rest, still)] == [[1, 2, 3], [9], [4]]
    assert lookup.rotates(50, 50) and not lookup.rotates(51, 50)


def test_starting(spark):
    with pytest.raises(RuntimeError):
        bootstrap.started(spark.range(0))
    pings = spark.createDataFrame([(i < 3,) for i in range(9)], "answered boolean")
    assert [bootstrap.start_decision(pings, n).first().decision for n in (3, 4)] == ["warm", "bootstrap"]
    assert bootstrap.start_decision(pings.limit(0), 0).first().decision == "bootstrap"
    assert text.next_option(["a", "b"], "b") == "a" and text.next_option(["a", "b"], "?") == "a" and text.log_level("WARN") == "warn" and text.log_level("x") == "info"


def test_nearest_of_clustered_ids(spark):
    """Ids that share long prefixes, repeated nodes, fewer nodes than asked for."""
    r = random.Random(8)
    nodes = [f"{r.choice([0, 0xABCDEF0123456789, 0xABCDEF012345678A]):016x}" + f"{r.getrandbits(96):024x}" for _ in range(200)]
    targets = [nodes[0], "abcdef0123456789" + "0" * 24, "f" * 40]
    df = spark.createDataFrame([(n, 0) for n in nodes + nodes[:5]], "node_id string, failure_count int")
    for k in (3, 500):
        got = routing.nearest(spark.createDataFrame([(t,) for t in targets], "target string"), df, k).collect()
        for t in targets:
            assert [x.node_id for x in sorted((x for x in got if x.target == t), key=lambda x: x.rank)] == sorted(set(nodes), key=lambda n: int(n, 16) ^ int(t, 16))[:k]

"""Protocol messages as rows: routing, replies, node lists and bencoded metadata."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heronlake.functions import ids
from heronlake.operators import routing

#: A decoded message.
MESSAGE = "t string, y string, q string, a struct<id:string,target:string,info_hash:string,token:string,port:int,implied_port:int>, r struct<id:string,nodes:binary,values:array<binary>,token:string,samples:binary,num:int,interval:int>, e array<string>, ip string, port int, at timestamp"


def routed(messages: DataFrame) -> dict[str, DataFrame]:
    """Replies (r and e) go to their requests, queries (q) to the handlers; others go nowhere."""
    return {"transactions": messages.where(F.col("y").isin("r", "e")), "queries": messages.where((F.col("y") == "q") & F.col("q").isin("ping", "find_node", "get_peers", "announce_peer", "sample_infohashes"))}


def correlate(requests: DataFrame, replies: DataFrame, timeout_seconds: int) -> DataFrame:
    """Each request with the reply of its transaction within the time, or none (``answered`` false)."""
    late = F.col("q.sent_at") + F.make_dt_interval(secs=F.lit(float(timeout_seconds)))
    rows = requests.alias("q").join(replies.alias("s"), (F.col("q.t") == F.col("s.t")) & (F.col("s.at") >= F.col("q.sent_at")) & (F.col("s.at") <= late), "left")
    return rows.groupBy("q.t", "q.sent_at").agg(F.min("s.at").alias("answered_at")).withColumn("answered", F.col("answered_at").isNotNull())


def observed(messages: DataFrame) -> DataFrame:
    """Senders whose id fits their address, as ``node_id, ip, port, at``."""
    node = ids.parse_hex(F.coalesce("a.id", "r.id"))
    rows = messages.select(node.alias("node_id"), "ip", "port", "at")
    return rows.where(F.col("node_id").isNotNull() & ids.valid_for_ip(F.col("node_id"), F.col("ip")))


def node_lists(nodes: Column) -> Column:
    """All nodes of a compact string, or none if it is malformed."""
    return F.coalesce(ids.decode_nodes(nodes), F.array().cast("array<struct<id:string,addr:struct<ip:string,port:int>>>"))


def valid_nodes(replies: DataFrame) -> DataFrame:
    """``node_id, ip, port`` of the nodes in replies that fit their addresses."""
    rows = replies.select(F.explode(node_lists(F.col("r.nodes"))).alias("n")).select(F.col("n.id").alias("node_id"), "n.addr.ip", "n.addr.port")
    return rows.where(ids.valid_for_ip(F.col("node_id"), F.col("ip")))


def find_node_replies(queries: DataFrame, nodes: DataFrame, k: int = 8, most: int = 8) -> DataFrame:
    """``target, nodes`` (binary) for each target or, failing that, info hash; without either, error 203."""
    asked = queries.select(ids.parse_hex(F.coalesce("a.target", "a.info_hash")).alias("target"))
    near = routing.nearest(asked.where("target IS NOT NULL").distinct(), nodes.where(ids.ip_number(F.col("ip")).isNotNull()), min(k, most))
    one = near.join(nodes.select("node_id", "ip", "port"), "node_id").withColumn("b", F.hex(ids.encode_node(F.col("node_id"), F.col("ip"), F.col("port"))))
    lists = one.groupBy("target").agg(F.unhex(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "b"))), lambda x: x["b"]), "")).alias("nodes"))
    return asked.join(lists, "target", "left").withColumn("error", F.when(F.col("target").isNull(), 203))


def get_peers_replies(queries: DataFrame, live: DataFrame, nodes: DataFrame, window: Column, secret: str, most: int = 50, k: int = 8) -> DataFrame:
    """``target, ip, token`` with ``values`` (live peers, compact) or, where there are none, the nearest ``nodes`` (compact); never both."""
    from pyspark.sql import Window as Win

    asked = queries.select(F.col("a.info_hash").alias("target"), "ip").withColumn("token", ids.announce_token(F.col("ip"), window, secret))
    ranked = live.withColumn("i", F.row_number().over(Win.partitionBy("infohash").orderBy(F.col("seen_at").desc(), "ip", "port"))).where(F.col("i") <= most)
    values = ranked.groupBy("infohash").agg(F.sort_array(F.collect_list(F.hex(ids.encode_peer(F.col("peer_ip") if "peer_ip" in live.columns else F.col("ip"), F.col("port"))))).alias("values")).withColumnRenamed("infohash", "target")
    rows = asked.join(values, "target", "left")
    lonely = rows.where("values IS NULL").select(F.struct(F.col("target"), F.lit(None).cast("string").alias("info_hash")).alias("a")).distinct()
    near = find_node_replies(lonely, nodes, k, k).select("target", "nodes")
    return rows.join(near, "target", "left").select("target", "ip", "token", "values", "nodes")


def sample_reply(keys: DataFrame, interval: int = 300, seed: int = 0, most: int = 500) -> DataFrame:
    """``samples`` (binary), ``num`` of all keys and the interval (300 seconds if it is none)."""
    picked = routing.sample_keys(keys, most, seed).agg(F.unhex(F.array_join(F.sort_array(F.collect_list("infohash")), "")).alias("samples"))
    return picked.crossJoin(keys.agg(F.countDistinct("infohash").alias("num"))).withColumn("interval", F.lit(interval if interval > 0 else 300))  # one row each


def sample_replies(queries: DataFrame, keys: DataFrame, nodes: DataFrame, k: int = 8, **options) -> DataFrame:
    """``target, nodes, samples, num, interval`` for each query: the nearest nodes to its target and one sample for all; without a target, error 203."""
    asked = queries.select("a").withColumn("a", F.col("a").withField("info_hash", F.lit(None).cast("string")))
    return find_node_replies(asked, nodes, k, k).crossJoin(F.broadcast(sample_reply(keys, **options)))  # one row


def ping_replies(queries: DataFrame, own: str) -> DataFrame:
    """``t, id``: one's own id to every ping."""
    return queries.where((F.col("y") == "q") & (F.col("q") == "ping")).select("t", F.lit(own).alias("id"))


#: Queries that have a handler.
HANDLERS = ("ping", "find_node", "get_peers", "announce_peer", "sample_infohashes")


def dispatch(messages: DataFrame, rate: float, burst: int, **limits) -> tuple[DataFrame, dict[str, DataFrame], DataFrame]:
    """Of queries (``y``, ``q``, ``ip``, ``at``, ``seq``): how many came of each type (``q, n``), those that their address's limit lets through by handler, and the senders to note."""
    from heronlake.streaming import state

    queries = messages.where(F.col("y") == "q")
    allowed = state.rate_limited(queries, rate, burst, **limits).where("allowed").select(F.col("seq").alias("__seq"))
    through = queries.join(allowed, F.col("seq") == F.col("__seq"), "left_semi")
    return queries.groupBy("q").agg(F.count("*").alias("n")), {q: through.where(F.col("q") == q) for q in HANDLERS}, through


def node_json(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.to_json(F.struct(F.col("node_id").alias("id"), F.concat_ws(":", "ip", F.col("port").cast("string")).alias("addr"), "last_seen", "failures")).alias("json"))


def parse_node_json(rows: DataFrame) -> DataFrame:
    got = rows.select(F.from_json("json", "id string, addr string, last_seen timestamp, failures int").alias("n"))
    port = F.substring_index("n.addr", ":", -1)
    return got.select(F.col("n.id").alias("node_id"), F.expr("substring(n.addr, 1, length(n.addr) - length(substring_index(n.addr, ':', -1)) - 1)").alias("ip"), port.cast("int").alias("port"), "n.last_seen", "n.failures")


def bdecode(data: bytes, at: int = 0):
    """A bencoded value and where it ends; ``ValueError`` or ``TypeError`` if it is none. Nesting costs no stack."""
    opened: list[tuple[list, bool]] = []
    while True:
        kind = data[at : at + 1]
        if kind in (b"l", b"d"):
            opened.append(([], kind == b"d"))
            at += 1
            continue
        if kind == b"e" and opened:
            items, named = opened.pop()
            if named and not all(isinstance(k, bytes) for k in items[::2]):
                raise ValueError("a name that is no string")
            value, at = dict(zip(items[::2], items[1::2], strict=True)) if named else items, at + 1
        elif kind == b"i":
            end = data.index(b"e", at)
            digits = data[at + 1 : end]
            if not re.fullmatch(rb"-?\d{1,19}", digits):
                raise ValueError("no number")
            value, at = int(digits), end + 1
        else:
            length = re.compile(rb"\d{1,10}:").match(data, at)
            if not length or length.end() + int(length[0][:-1]) > len(data):
                raise ValueError("no string")
            end = length.end() + int(length[0][:-1])
            value, at = data[length.end() : end], end
        if not opened:
            return value, at
        opened[-1][0].append(value)


def torrent_info(data: bytes) -> tuple[str, list[tuple[str, int]], int]:
    """Name, files (paths joined by slashes) and total size; a single file is named like the whole. ``ValueError`` for anything else."""
    def need(x, kind: type):
        if not isinstance(x, kind) or (kind is int and not 0 <= x < 1 << 63):
            raise ValueError("another type than expected")
        return x

    info = need(bdecode(data)[0], dict)
    clean = lambda b: need(b, bytes).decode("utf-8", "ignore")
    name = clean(info.get(b"name"))
    if b"files" in info:
        entries = [need(f, dict) for f in need(info[b"files"], list)]
        files = [("/".join(clean(p) for p in need(f.get(b"path"), list)), need(f.get(b"length"), int)) for f in entries]
    else:
        files = [(name, need(info.get(b"length", 0), int))]
    return name, files, need(sum(n for _, n in files), int)


def metadata(rows: DataFrame) -> DataFrame:
    """``infohash, name, files, total_size`` of ``infohash, info`` (bencoded) whose SHA-1 is the infohash and that decode."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from heronlake.sources.messages import torrent_info

        for p in parts:
            out = []
            for infohash, info in zip(p["infohash"], p["info"], strict=True):
                try:
                    name, files, total = torrent_info(bytes(info))
                except (ValueError, TypeError):  # not a description of files
                    continue
                out.append((infohash, name, [{"path": a, "size": n} for a, n in files], total))
            yield pd.DataFrame(out, columns=["infohash", "name", "files", "total_size"])

    checked = rows.where(F.sha1("info") == F.col("infohash")).select("infohash", "info")
    return checked.mapInPandas(run, "infohash string, name string, files array<struct<path:string,size:long>>, total_size long")

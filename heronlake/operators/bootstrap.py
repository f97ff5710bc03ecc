"""Starting and refreshing a node's table: hosts, seeds, warm restarts, stale buckets, and which periodic jobs are due."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heronlake.functions import ids
from heronlake.operators import routing

MOST_PINGS = 200  # nearest nodes that a warm restart asks
#: Periodic jobs, and the seconds between their runs.
JOBS = {"scrape": 30, "dead": 3600, "prune": 86_400, "stats": 60}


def host_list(rows: DataFrame, column: str = "hosts") -> DataFrame:
    """``host, port`` of comma-separated ``host:port`` entries; entries that are none are skipped."""
    got = rows.select(F.explode(F.split(F.coalesce(F.col(column), F.lit("")), r"\s*,\s*")).alias("e")).select(F.trim("e").alias("e"))
    port = F.regexp_extract("e", r"^[^:\s]+:(\d{1,5})\z", 1).try_cast("int")
    return got.select(F.regexp_extract("e", r"^([^:\s]+):\d{1,5}\z", 1).alias("host"), port.alias("port")).where((F.col("host") != "") & F.col("port").between(0, 65535))


def to_ping(nodes: DataFrame, own: str, most: int = MOST_PINGS) -> DataFrame:
    """The nearest nodes to one's own id, which a warm restart asks."""
    spark = nodes.sparkSession
    return routing.nearest(spark.range(1).select(F.lit(own).alias("target")), nodes, most).select("node_id")


def start_decision(pings: DataFrame, threshold: int) -> DataFrame:
    """``asked, live, decision``: ``warm`` if enough of the pinged nodes answered (``answered``), else ``bootstrap``."""
    got = pings.agg(F.count("*").alias("asked"), F.count_if("answered").alias("live"))
    return got.withColumn("decision", F.when((F.col("asked") > 0) & (F.col("live") >= threshold), "warm").otherwise("bootstrap"))


def started(nodes: DataFrame) -> None:
    """After the bootstrap the table must hold a node."""
    if nodes.isEmpty():
        raise RuntimeError("no nodes in the routing table")


def seed_answers(replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the seeds' answers (``nodes, ip``, both binary): ``node_id, ip, port`` of the nodes that fit their addresses, and ``external`` addresses of four bytes."""
    nodes = replies.select(F.explode(ids.decode_nodes(F.col("nodes"))).alias("n")).select(F.col("n.id").alias("node_id"), "n.addr.ip", "n.addr.port")
    byte = lambda k: F.conv(F.hex(F.substring("ip", k, 1)), 16, 10)
    told = replies.where(F.octet_length("ip") == 4).select(F.concat_ws(".", *(byte(k) for k in (1, 2, 3, 4))).alias("external"))
    return nodes.where(ids.valid_for_ip(F.col("node_id"), F.col("ip"))).distinct(), told


def refresh_targets(buckets: DataFrame, now: Column, seconds: int, seed: int = 0) -> DataFrame:
    """``bucket, target``: an id inside each stale bucket (``bucket, low, high, depth, last_changed``), to ask its nearest nodes for."""
    stale = routing.stale_buckets(buckets, now, seconds)
    return stale.select("bucket", ids.in_prefix(F.col("low"), F.col("depth"), F.concat(F.col("bucket").cast("string"), F.lit(f":{seed}"))).alias("target"))


def node_count(nodes: DataFrame) -> DataFrame:
    """Active nodes of a table's snapshot (``spare``: replacements, which don't count)."""
    return nodes.agg(F.count_if(~F.coalesce(F.col("spare"), F.lit(False))).alias("n"))


def due_jobs(runs: DataFrame, now: Column) -> DataFrame:
    """``job, due_at, due`` of every periodic job; ``runs`` (``job, at``) are the runs so far, and one that never ran is due."""
    jobs = F.explode(F.create_map(*(x for k, v in JOBS.items() for x in (F.lit(k), F.lit(v)))))
    known = runs.sparkSession.range(1).select(jobs.alias("job", "seconds"))  # as many rows as jobs
    last = runs.groupBy("job").agg(F.max("at").alias("at"))
    due_at = F.col("at") + F.make_dt_interval(secs=F.col("seconds").cast("double"))
    return known.join(last, "job", "left").select("job", due_at.alias("due_at"), F.coalesce(due_at <= now, F.lit(True)).alias("due"))

"""Tracker addresses, packets and replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def udp_hosts(trackers: DataFrame, url: str = "url") -> DataFrame:
    """``url, host`` (with its port) of the UDP trackers; others are left out."""
    host = F.regexp_extract(url, r"^udp://([^/?#\s]+)", 1)
    return trackers.select(url, host.alias("host")).where(F.col("host") != "")


def decode_reply(requests: DataFrame) -> DataFrame:
    """``infohash, seeders, completed, leechers`` of replies.

    ``requests``: ``hashes`` (in the order asked) and ``reply`` bytes: eight of header, then twelve for each hash; a short reply answers the first ones.
    """
    u32 = lambda at: F.conv(F.hex(F.substring(F.col("reply"), at, F.lit(4))), 16, 10).cast("long")
    rows = requests.select("reply", F.posexplode("hashes").alias("pos", "infohash")).where(F.octet_length("reply") >= 8 + 12 * (F.col("pos") + 1))
    at: Column = F.col("pos") * 12 + 9
    return rows.select("infohash", u32(at).alias("seeders"), u32(at + 4).alias("completed"), u32(at + 8).alias("leechers"))

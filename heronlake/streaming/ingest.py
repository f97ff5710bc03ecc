"""From discovered keys and fetched metadata to stored, classified rows; the same function for a batch and each micro-batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heronlake.functions import classify as C
from heronlake.functions import text
from heronlake.operators import dml, lifecycle
from heronlake.schemas import SCHEMAS, rules, with_defaults
from heronlake.sources.tables import TableStore


def ingest(fetched: DataFrame, stored: DataFrame, now: Column, max_peers: int = 100, settings: C.Settings | None = None) -> dict[str, DataFrame]:
    """New ``torrents`` and ``torrent_files`` of a log of fetches (``infohash, seq, peer_rank, ok, name, total_size``, optional ``files``).

    Keys that are stored are left out first; then each key's first success counts, its text
    cleaned; the safety gate stands before everything that is kept or shown. A name that the
    table's check forbids is refused whole (``refused``), as the table would, never shortened.
    """
    new = fetched.join(stored.select("infohash"), "infohash", "left_anti")
    got = lifecycle.first_metadata(new, max_peers)
    got = got.withColumn("name", text.clean_utf8(F.col("name")))
    if "files" in fetched.columns:
        got = got.withColumn("files", F.transform("files", lambda f: f.withField("path", text.clean_utf8(f["path"]))))
    files = F.col("files") if "files" in fetched.columns else None
    gated = got.where(~C.blocked(F.col("name"), files))
    fits = F.coalesce(rules("torrents")["name_length"], F.lit(True))
    safe = gated.where(fits)
    rows = C.classify(safe, settings)
    torrents = rows.select("infohash", "name", "total_size", (F.size("files") if files is not None else F.lit(0)).alias("file_count"), F.col("result.state").alias("state"), F.col("result.content_type").alias("content_type"), *(c.alias(k) for k, c in C.nulled().items()), F.col("result.rejection_reason").alias("rejection_reason"))
    out = {"torrents": with_defaults(torrents, now), "reasons": torrents.select("infohash", "rejection_reason"), "refused": gated.where(~fits).select("infohash", F.lit("name_length").alias("reason"))}
    if files is not None:
        out["torrent_files"] = dml.explode_files(safe.select("infohash", F.transform("files", lambda f: f["path"]).alias("paths"), F.transform("files", lambda f: f["size"]).alias("sizes")))
    return out


def announces(messages: DataFrame, window: Column, secret: str) -> DataFrame:
    """Announcements with a valid token and port, as ``infohash, ip, port, event_id, seen_at``."""
    from heronlake.functions import ids

    port = ids.effective_port(F.col("implied_port"), F.col("port"), F.col("source_port"))
    rows = messages.where(ids.token_valid(F.col("token"), F.col("ip"), window, secret)).withColumn("port", port)
    return rows.where(F.col("port").isNotNull()).select("infohash", "ip", "port", "event_id", "seen_at")


def discovered(messages: DataFrame, window: Column, secret: str, rotation_seconds: int) -> tuple[DataFrame, DataFrame]:
    """Announcements that are taken, for the peer store, and those that go on to be fetched: what two rotating sets let through."""
    from heronlake.streaming import state

    taken = announces(messages, window, secret)
    return taken, state.rotating_dedup(taken, rotation_seconds)


def message_stream(spark, folder: str, schema: str | None = None, most_files: int = 100):
    """A stream of decoded messages from a folder of JSON lines; ``most_files`` a trigger bound what a batch takes, and rows that are no messages are left out."""
    from heronlake.sources.messages import MESSAGE

    rows = spark.readStream.schema(schema or MESSAGE).option("maxFilesPerTrigger", most_files).option("mode", "DROPMALFORMED").json(folder)
    return rows.where(F.col("y").isNotNull())


def start(stream: DataFrame, store: TableStore, checkpoint: str, now: Column, **options):
    """A query that appends what each micro-batch of fetches adds, files before torrents; a repeated batch finds its keys stored and adds nothing."""
    def batch(df: DataFrame, _: int) -> None:
        own = TableStore(df.sparkSession, store.root, store.schemas, store.most_pieces)
        out = ingest(df, own.read("torrents"), now, **options)
        added = {}
        if "torrent_files" in out:
            names = SCHEMAS["torrent_files"].names
            files = out["torrent_files"].withColumns({"id": F.xxhash64("infohash", "path"), "created_at": now, "updated_at": now}).select(*names)
            added["torrent_files"] = files.join(own.read("torrent_files").select("infohash"), "infohash", "left_anti").select(*names)
        own.append(added | {"torrents": out["torrents"]})

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

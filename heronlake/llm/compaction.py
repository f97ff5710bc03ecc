"""Size-tiered compaction: small immutable shards, merged by size tier, under a versioned manifest.

An arrival is written as it is read, one Parquet shard a task and without a shuffle. A
manifest lists the live shards with their sizes and tiers; each version is one JSON
file, written aside and renamed to its number without overwriting, so that a version is
there whole or not at all and of two writers one fails. Compaction takes tiers with
enough shards below the target size, packs them into bins of about the target and
rewrites each bin as one file in one task, which reads its own shards only. Shards are
never changed, and those that a version replaced stay for readers of older versions;
:meth:`ShardSet.expire` removes them once the last :data:`KEPT_VERSIONS` no longer hold them
and a grace time has passed.

A manifest names its entries in pieces of :data:`PIECE` shards, which later versions share as
long as none of a piece's shards is replaced, so a version writes what it changed.

Rows are kept as they come: nulls, empty and very long texts, repeated rows and any
columns. An empty arrival adds no shard but still makes a version.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import asdict, dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from heronlake.llm import _store

TARGET_BYTES, TIER_BYTES, TIER_RATIO, LEAST_SHARDS = 64 << 20, 1 << 20, 4, 4
BINS_A_JOB = 64  # bins that one Spark job rewrites
PIECE = 10_000  # shards in a piece of a manifest
KEPT_VERSIONS, GRACE_SECONDS = 8, 3600  # what :meth:`ShardSet.expire` leaves to readers


@dataclass(frozen=True)
class Shard:
    path: str
    size: int
    tier: int
    born: int  # the version that added it


def tier_of(size: int) -> int:
    """Tier 0 up to :data:`TIER_BYTES`, then one for each factor :data:`TIER_RATIO`."""
    return max(0, math.ceil(math.log(max(size, 1) / TIER_BYTES, TIER_RATIO)))


def plan(shards: list[Shard], target: int = TARGET_BYTES, least: int = LEAST_SHARDS) -> list[list[Shard]]:
    """Bins of shards to merge: of each tier with ``least`` shards or more, in order of age, filled up to the target."""
    bins = []
    for tier in sorted({s.tier for s in shards}):
        same = sorted((s for s in shards if s.tier == tier and s.size <= target // 2), key=lambda s: (s.born, s.path))
        if len(same) < least:
            continue
        held: list[Shard] = []
        for s in same:
            if held and sum(x.size for x in held) + s.size > target:
                bins.append(held)
                held = []
            held.append(s)
        bins.append(held)
    return [b for b in bins if len(b) > 1]


class ShardSet:
    def __init__(self, spark: SparkSession, root: str, schema: StructType, target: int = TARGET_BYTES):
        self.spark, self.root, self.schema, self.target = spark, root.rstrip("/"), schema, target

    def version(self) -> int:
        fs, p = _store.file_system(self.spark, f"{self.root}/manifest")
        return max((int(f.getPath().getName()[1:-5]) for f in fs.listStatus(p) if f.getPath().getName().startswith("v")), default=0) if fs.exists(p) else 0

    def _json(self, path: str) -> dict:
        fs, p = _store.file_system(self.spark, path)
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _put(self, path: str, content: dict) -> None:
        """Whole or not at all, and never over another file: written beside its place and renamed."""
        fs, p = _store.file_system(self.spark, path)
        fs.mkdirs(p.getParent())
        _, aside = _store.file_system(self.spark, f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}")
        out = fs.create(aside)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self.spark._jsc.hadoopConfiguration())
        context.rename(aside, p, self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))

    def _pieces(self, version: int) -> dict[str, list[Shard]]:
        if not version:
            return {}
        names = self._json(f"{self.root}/manifest/v{version:08d}.json")["pieces"]
        return {n: [Shard(**s) for s in self._json(f"{self.root}/manifest/{n}")["shards"]] for n in names}

    def shards(self, version: int | None = None) -> list[Shard]:
        return [s for piece in self._pieces(self.version() if version is None else version).values() for s in piece]

    def commit(self, shards: list[Shard], based_on: int) -> int:
        """A new version after ``based_on``; fails if another writer was first. Pieces that hold live shards alone are kept as they are."""
        new, live = based_on + 1, {s.path for s in shards}
        same = {n: piece for n, piece in self._pieces(based_on).items() if all(s.path in live for s in piece)}
        held = {s.path for piece in same.values() for s in piece}
        rest = [s for s in shards if s.path not in held]
        names = list(same)
        for at in range(0, len(rest), PIECE):
            names.append(f"p{new:08d}-{at // PIECE}-{uuid.uuid4().hex[:8]}.json")
            self._put(f"{self.root}/manifest/{names[-1]}", {"shards": [asdict(s) for s in rest[at : at + PIECE]]})
        if len(names) > 1 and sum(len(same[n]) for n in same) < PIECE // 2 and same:  # small pieces become one again
            every = [s for n in same for s in same[n]] + rest
            names = [f"p{new:08d}-all-{uuid.uuid4().hex[:8]}.json"]
            self._put(f"{self.root}/manifest/{names[0]}", {"shards": [asdict(s) for s in every]})
        self._put(f"{self.root}/manifest/v{new:08d}.json", {"version": new, "pieces": names})
        return new

    def expire(self, keep: int = KEPT_VERSIONS, grace: int = GRACE_SECONDS) -> list[str]:
        """Removes data files that none of the last ``keep`` versions holds and that are older than ``grace`` seconds; their paths."""
        import time

        now = self.version()
        wanted = {s.path for v in range(max(1, now - keep + 1), now + 1) for s in self.shards(v)}
        fs, top = _store.file_system(self.spark, f"{self.root}/data")
        gone, until = [], (time.time() - grace) * 1000
        for folder in fs.listStatus(top) if fs.exists(top) else []:
            for f in fs.listStatus(folder.getPath()):
                path = f.getPath().toString()
                if path.endswith(".parquet") and path not in wanted and f.getModificationTime() <= until:
                    fs.delete(f.getPath(), False)
                    gone.append(path)
        return gone

    def _write(self, df: DataFrame, version: int, name: str) -> list[Shard]:
        """One shard for each partition with rows, in the order of the partitions."""
        path = f"{self.root}/data/{version:08d}-{name}-{_store.new_path(self.spark, 's')[-8:]}"
        df.write.parquet(path)
        fs, p = _store.file_system(self.spark, path)
        files = sorted((f.getPath().toString(), f.getLen()) for f in fs.listStatus(p) if f.getPath().getName().endswith(".parquet"))
        return [Shard(f, size, tier_of(size), version) for f, size in files]

    def append(self, arrival: DataFrame) -> int:
        base = self.version()
        new = self._write(arrival.select(*self.schema.names), base + 1, "arrival")
        return self.commit(self.shards(base) + new, base)

    def compact(self) -> int:
        """Merges until no tier has enough small shards; the version it ends with."""
        while True:
            base = self.version()
            live = self.shards(base)
            bins = plan(live, self.target)
            if not bins:
                return base
            merged: list[Shard] = []
            for at in range(0, len(bins), BINS_A_JOB):
                parts = [self.spark.read.schema(self.schema).parquet(*(s.path for s in b)).coalesce(1) for b in bins[at : at + BINS_A_JOB]]
                merged += self._write(reduce(DataFrame.union, parts), base + 1, f"merge{at}")
            old = {s.path for b in bins for s in b}
            self.commit([s for s in live if s.path not in old] + merged, base)

    def read(self, version: int | None = None) -> DataFrame:
        paths = [s.path for s in self.shards(version)]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def table(self) -> DataFrame:
        """The live manifest: ``shard`` (a number), ``file, shard_bytes, tier, version``."""
        v = self.version()
        rows = [(i, s.path.rpartition("/")[2], s.size, s.tier, v) for i, s in enumerate(self.shards(v))]
        schema = "shard int, file string, shard_bytes long, tier int, version int"
        # As Arrow, since rows would go through Python workers, which then stay in the executors' memory.
        columns = [pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 5, (pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.int32()), strict=True)]
        return self.spark.createDataFrame(pa.Table.from_arrays(columns, names=["shard", "file", "shard_bytes", "tier", "version"]), schema)


def load(docs: DataFrame, arrivals: int = 4, target: int = TARGET_BYTES) -> ShardSet:
    """``docs`` appended in arrivals (by a hash of ``doc_id``), with a compaction after each."""
    shards = ShardSet(docs.sparkSession, _store.new_path(docs.sparkSession, "shards"), docs.schema, target)
    for k in range(arrivals):
        shards.append(docs.where(F.pmod(F.xxhash64(F.col("doc_id")), F.lit(arrivals)) == k))
        shards.compact()
    return shards


def digest(docs: DataFrame, **options) -> DataFrame:
    """What the live version holds, read back: each row's id, text digest, and its shard."""
    shards = load(docs.select("doc_id", "text", *(c for c in docs.columns if c not in ("doc_id", "text"))), **options)
    # The manifest has a row for each file of about the target size, and is read by the driver anyway.
    where = F.broadcast(shards.table())
    rows = shards.read().select("doc_id", F.octet_length("text").cast("long").alias("text_bytes"), F.md5("text").alias("text_md5"), F.col("_metadata.file_name").alias("file")) if shards.shards() else shards.read().select("doc_id", F.lit(0).cast("long").alias("text_bytes"), F.lit("").alias("text_md5"), F.lit("").alias("file"))
    return rows.join(where, "file").drop("file")

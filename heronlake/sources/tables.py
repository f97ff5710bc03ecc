"""Versioned Parquet tables: whole new versions or appended rows, an atomic pointer, one writer a table."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one, set now, only where the session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    got = spark.sparkContext.getCheckpointDir()
    if got:
        return got
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="heronlake-checkpoints-"))
    return spark.sparkContext.getCheckpointDir()


class TableStore:
    """Tables under ``root``: each write or append makes folders ``root/table/data-*`` and then moves the pointer, which lists a version's folders.

    An append writes its own rows alone, whatever the table holds. A version of over
    ``most_pieces`` folders is written as one by the append that would exceed them.
    """

    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, StructType], most_pieces: int = 64):
        self.spark, self.root, self.schemas, self.most_pieces = spark, root.rstrip("/"), schemas, most_pieces

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _pointers(self, table: str) -> list[int]:
        fs, p = self._fs(f"{self.root}/{table}/_versions")
        return sorted(int(f.getPath().getName()) for f in fs.listStatus(p) if f.getPath().getName().isdigit()) if fs.exists(p) else []

    def version(self, table: str) -> int:
        return max(self._pointers(table), default=0)

    def read(self, table: str, version: int | None = None) -> DataFrame:
        v = self.version(table) if version is None else version
        if not v:
            return self.spark.createDataFrame([], self.schemas[table])
        return self.spark.read.schema(self.schemas[table]).parquet(*self._pieces(table, v))

    def _pieces(self, table: str, version: int) -> list[str]:
        fs, p = self._fs(f"{self.root}/{table}/_versions/{version}")
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode().split("\n")
        finally:
            stream.close()

    def write(self, table: str, df: DataFrame, keep: int = 2) -> int:
        """The table's next version; the data is complete before the pointer is there. Older versions but ``keep`` go, and their data."""
        return self.commit({table: df}, keep)[table]

    def append(self, rows: dict[str, DataFrame], keep: int = 2) -> dict[str, int]:
        """Next versions of tables, with these rows more; the pointers move in the order given."""
        old = {table: self._pieces(table, v) if (v := self.version(table)) else [] for table in rows}
        full = {table for table, pieces in old.items() if len(pieces) >= self.most_pieces}
        whole = {table: self.read(table).unionByName(df) if table in full else df for table, df in rows.items()}
        return self.commit(whole, keep, {table: [] if table in full else pieces for table, pieces in old.items()})

    def commit(self, changed: dict[str, DataFrame], keep: int = 2, before: dict[str, list[str]] | None = None) -> dict[str, int]:
        """Next versions of several tables: all data is there before the first pointer moves. ``before``: folders that a table's version has besides."""
        placed = {}
        for table, df in changed.items():
            new = self.version(table) + 1
            path = f"{self.root}/{table}/data-{new}-{uuid.uuid4().hex[:8]}"
            df.select(*(df[f.name].cast(f.dataType) for f in self.schemas[table].fields)).write.parquet(path)
            placed[table] = new, [*(before or {}).get(table, []), path]
        for table, (new, pieces) in placed.items():
            fs, aside = self._fs(f"{self.root}/{table}/_versions/.{uuid.uuid4().hex}")
            out = fs.create(aside)
            out.write(bytearray("\n".join(pieces).encode()))
            out.close()
            if not fs.rename(aside, self._fs(f"{self.root}/{table}/_versions/{new}")[1]):
                raise RuntimeError(f"another writer made version {new} of {table}")
            self._forget(table, keep)
        return {table: new for table, (new, _) in placed.items()}

    def _forget(self, table: str, keep: int) -> None:
        """Removes all but the last ``keep`` versions and the folders that these lack; readers of these are safe while so many writes pass."""
        versions = self._pointers(table)
        held = {piece for v in versions[-keep:] for piece in self._pieces(table, v)}
        for old in versions[:-keep]:
            gone = [piece for piece in self._pieces(table, old) if piece not in held]
            fs, pointer = self._fs(f"{self.root}/{table}/_versions/{old}")
            fs.delete(pointer, False)
            for piece in gone:
                fs.delete(self._fs(piece)[1], True)

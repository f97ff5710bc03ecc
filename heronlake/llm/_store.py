"""Tables in the folder that the driver and all executors share (``spark.checkpoint.dir``)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder only for a local session that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local") or spark.conf.get("spark.master").startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    global _own
    if not _own:
        _own = "file://" + tempfile.mkdtemp(prefix="heronlake-")
    return _own


_own = ""
_kept: list[str] = []  # paths of tables that :func:`release` removes

BATCH_BYTES = 1 << 20  # of an Arrow batch sent to Python; a longer document makes a batch of its own
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session whose Arrow batches are bounded by bytes: 10,000 whole texts at once fill the JVM's and the worker's memory. A lower bound stays."""
    spark = df.sparkSession
    now = spark.conf.get(_BATCH).removesuffix("b")
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    return df


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/heronlake/{name}-{uuid.uuid4().hex}"


def kept_table(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written once to the shared folder and read again, so that a lost executor costs no recomputation; its path."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path)
    _kept.append(path)
    return spark.read.schema(df.schema).parquet(path), path


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system and path object for ``path``."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def release(spark: SparkSession) -> None:
    """Removes every table that operators of this process wrote to the shared folder, those behind results handed on too: call it when these have been used."""
    while _kept:
        drop(spark, _kept.pop())


def drop(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        fs, p = file_system(spark, path)
        fs.delete(p, True)

"""Making the package known to a session's Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


SMALL_BYTES = 64 << 20  # of a table that is dealt anew to all cores


def read_spread(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table for work that is heavy a row. One of a few row groups would keep a few cores busy, so the rows of a small table are dealt out first; larger ones are read as they lie."""
    df = spark.read.parquet(path)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength()
    return df.repartition(spark.sparkContext.defaultParallelism) if size <= SMALL_BYTES else df


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors, once a Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_heronlake_shipped", False):
        return spark
    top = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="heronlake-ship-"), "heronlake.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, str(Path(top.name) / p.relative_to(top)))
    sc.addPyFile(path)
    sc._heronlake_shipped = True
    return spark

"""Token ids as Parquet list columns, for selective reads of ids or of metadata alone.

Documents are dealt by ranges of ``doc_id`` and sorted within each, encoded, and written
by Spark's Parquet writer with the asked encoding (dictionary or delta), row-group and
page sizes; page indexes come with it, so a reader of a few documents or of counts alone
skips the rest. ``part`` numbers the ranges in order and ``part_start`` counts the ids
before a document in its part, so that global offsets need only the parts' totals.

Null or empty text is the end id alone. Null ids come first; rows with the same id are in
text order. Other columns are not written. An empty table writes no rows.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as Win
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heronlake.llm import _store
from heronlake.llm import _words as W

END_ID = 1
CHUNKS, RUNS = 1_500_000, 1_000_000  # entries that a worker remembers; beyond, it starts again
SCHEMA = T.StructType([
    T.StructField("part", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("part_start", T.LongType()),
    T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
])
#: Letters that neither normalisation nor case mapping changes beyond one letter, then punctuation: two runs for the tokenizer.
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?#*$%&|]*)")
_encoders: dict[str, "Encoder"] = {}


class _Chunks(dict):
    """Ids of chunks, learnt when first asked for."""

    def __init__(self, learn):
        self.learn = learn

    def __missing__(self, chunk: bytes) -> bytes:
        got = self[chunk] = self.learn(chunk)
        return got


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: What the short cuts are held against: case, accents, marks, digits, contractions and odd spaces.
_PROBES = ("Hello, World! it's 42 o'clock", "ÀÉÎ ß ÿ øre; naïve façade...", " a\tb\n\nc  d ", "#tag $5.00 100% a&b x|y", "ABCdef ghiJKL mno!?", "don't we'll 3rd 007", "Ünï-cödé (test) [x] {y}", "a.b,c;d:e", "x\u00a0y z\u2028w")


class Encoder:
    """Ids of white-space separated chunks, each encoded once while it is remembered.

    This holds for a tokenizer that drops white space and splits there: a text's ids are
    then those of its chunks one after another. A tokenizer for which it does not hold, by
    its parts or on :data:`_PROBES`, encodes whole texts plainly.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x100)}
        self.chunks = _Chunks(self.learn)
        self.runs: dict[str, bytes] = {}
        self.plain = False
        self.plain = not self._splits_at_space() or any(a != self._whole(t) for t, a in zip(_PROBES, self.encode([p.encode() for p in _PROBES], b""), strict=True))

    def _splits_at_space(self) -> bool:
        """Whether the parts are those that the short cuts follow: lower case after composition and single spaces, split and dropped white space, then bytes."""
        spec = json.loads(self.tokenizer.to_str())
        kinds = lambda part, key: [x["type"] for x in part[key]] if part and part["type"] == "Sequence" else [part["type"]] if part else []
        split = [x for x in (spec["pre_tokenizer"] or {}).get("pretokenizers", []) if x["type"] == "Split"]
        return kinds(spec["normalizer"], "normalizers") == ["NFC", "Replace", "Lowercase"] and kinds(spec["pre_tokenizer"], "pretokenizers") == ["Split", "ByteLevel"] and split[0]["behavior"] == "Removed" and split[0]["invert"] and spec["model"]["type"] == "BPE"

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<i4").tobytes()

    def run(self, s: str) -> bytes:
        got = self.runs.get(s)
        if got is None:
            got = self.runs[s] = np.array([t.id for t in self.tokenizer.model.tokenize(s.translate(self.letters))], "<i4").tobytes() if s else b""
        return got

    def learn(self, chunk: bytes) -> bytes:
        text = chunk.decode("utf-8", "replace")
        if m := _PLAIN.fullmatch(text):
            return self.run(m[1].lower()) + self.run(m[2])
        return self._whole(text)

    def encode(self, texts: list[bytes], end: bytes) -> list[bytes]:
        if self.plain:
            return [self._whole(t.decode("utf-8", "replace")) + end for t in texts]
        if len(self.chunks) > CHUNKS:
            self.chunks.clear()
        if len(self.runs) > RUNS:
            self.runs.clear()
        get = self.chunks.__getitem__
        return [b"".join(map(get, t.split())) + end for t in texts]


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, encoding: str = "dictionary", row_group_bytes: int = 32 << 20, page_bytes: int = 1 << 20, page_rows: int = 2_000) -> None:
    """The ids of every whole text in ascending ``doc_id``; ``encoding``: dictionary or delta (of ids; the other columns are delta coded)."""
    tokenizer, end = tokenizer or default_tokenizer(), np.array([end_id], "<i4").tobytes()
    if encoding not in ("dictionary", "delta"):
        raise ValueError("encoding is dictionary or delta")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, at = encoder(tokenizer), 0
        for batch in batches:
            for piece in W.slices(batch, "text"):
                data, offsets = W.buffers(piece.column("text"))
                data = data.tobytes()
                ids = encode.encode([data[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], end)
                n = np.array([len(x) // 4 for x in ids], np.int64)
                ends = np.concatenate([[0], np.cumsum(n)])
                values = pa.array(np.frombuffer(b"".join(ids), "<i4"))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, pa.list_(pa.field("element", pa.int32(), False)))
                yield pa.RecordBatch.from_arrays([piece.column("part"), piece.column("doc_id"), pa.array(at + ends[:-1]), pa.array(n), lists], names=SCHEMA.names)
                at += int(ends[-1])

    ordered = docs.select("doc_id", "text").repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    out = ordered.select(F.spark_partition_id().alias("part"), F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
    (
        out.write.option("compression", "zstd").option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.enable.dictionary", "false").option("parquet.enable.dictionary#ids.list.element", str(encoding == "dictionary").lower())
        .option("parquet.block.size", row_group_bytes).option("parquet.page.size", page_bytes).option("parquet.page.row.count.limit", page_rows)
        .parquet(path)
    )


def read(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """The files' rows; ask for columns and filter by ``doc_id`` to read only their pages."""
    return spark.read.schema(SCHEMA).parquet(path).select(*(columns or SCHEMA.names))


def starts(spark: SparkSession, path: str) -> DataFrame:
    """``part`` and the ids of all parts before it, from the counts alone."""
    totals = read(spark, path, "part", "n_tokens").groupBy("part").agg(F.sum("n_tokens").alias("n"))
    return totals.select("part", (F.sum("n").over(Win.orderBy("part")) - F.col("n")).alias("before"))  # one row a part


def digest(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` from the files."""
    schema = T.StructType([*SCHEMA.fields[:4], T.StructField("ids_crc32", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("ids")
            data, ends = np.asarray(ids.values), np.asarray(ids.offsets)
            crc = [zlib.crc32(data[a:z].astype("<u4").tobytes()) for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in SCHEMA.names[:4]), pa.array(crc, pa.int64())], names=schema.names)

    rows = read(spark, path).mapInArrow(run, schema)
    return rows.join(starts(spark, path), "part").select("doc_id", (F.col("before") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32")


def write_and_read(docs: DataFrame, **options) -> DataFrame:
    spark = docs.sparkSession
    path = _store.new_path(spark, "token-files")
    write(docs, path, **options)
    return digest(spark, path)

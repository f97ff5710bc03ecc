"""Steps that depend on the ones before, key by key, in memory that one key's state bounds."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

_ROWS = 20_000  # of output held at a time


def fold(df: DataFrame, keys: list[str], order: list[str], schema: str, start: Callable, step: Callable, end: Callable | None = None) -> DataFrame:
    """What ``step(state, key, row)`` gives for the rows of each key in order, and ``end(state, key)`` after the last; ``start(key)`` makes the state.

    Rows are sorted by Spark and read as a stream, so a busy key's log is never held. Without keys all rows are one sequence.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(T.StructType.fromDDL(schema))
    rest = [c for c in df.columns if c not in keys]
    n = len(keys)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    def results(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        state, held, any_ = None, None, False
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                key = row[:n]
                if not any_ or key != held:
                    if any_ and end:
                        yield from end(state, held)
                    state, held, any_ = start(key), key, True
                yield from step(state, key, row[n:])
        if any_ and end:
            yield from end(state, held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for r in results(batches):
            out.append(r)
            if len(out) >= _ROWS:
                yield batch(out)
                out = []
        if out:
            yield batch(out)

    rows = df.select(*keys, *rest)
    rows = rows.repartition(*keys) if keys else rows.repartition(1)
    return rows.sortWithinPartitions(*keys, *order).mapInArrow(run, schema)

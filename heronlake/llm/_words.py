"""Words, lines and shingles of a whole Arrow text column at once, as 64-bit hashes.

A word is ``[^\\x20\\x09-\\x0D]+`` of the UTF-8 bytes. Words are hashed by a polynomial
over a random byte table modulo 2**64 and then mixed, all by running sums over the
column's buffer, so no Python object is made per word. Texts are never shortened.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
SLICE_BYTES = 1 << 20  # text handled at a time; a longer document makes a slice of its own
FEW_BYTES = 1 << 18  # of text, where workers wait beside other work of their executor and what they keep counts


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit values (the splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = x + U((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


BYTE = mix(np.arange(256, dtype=U), 11) | U(1)
STEP, BACK = 0xD1342543DE82EF95, pow(0xD1342543DE82EF95, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size, tables = max(FEW_BYTES, 1 << (n - 1).bit_length()) + 1, []
        for base in (STEP, BACK):
            t = np.full(size, base, U)
            t[0] = 1
            with np.errstate(over="ignore"):
                tables.append(np.multiply.accumulate(t))
        if size > 4 * SLICE_BYTES:  # of a very long document; not kept
            return tables
        _powers[:] = tables
    return _powers


@dataclass
class Words:
    data: np.ndarray  # bytes, lower-cased if asked for
    offsets: np.ndarray  # of documents in data
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray  # of each word
    inside: np.ndarray  # whether a byte belongs to a word
    sums: np.ndarray  # running polynomial sums, one longer than data
    back: np.ndarray

    @property
    def n_docs(self) -> int:
        return len(self.offsets) - 1

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of byte spans."""
        with np.errstate(over="ignore"):
            return mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(U) * U(0xA24BAED4963EE407))

    def count(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.n_docs)

    def first(self) -> np.ndarray:
        """The place of each document's first word; one more than there are documents."""
        return np.concatenate([[0], np.cumsum(self.count())])


def per_doc(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many bytes of each document are flagged."""
    run = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return run[offsets[1:]] - run[offsets[:-1]]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)


def words(column: pa.Array, lower: bool = False) -> Words:
    data, offsets = buffers(column)
    if lower:
        data = LOWER[data]
    inside = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]]) if len(data) else inside
    after = np.concatenate([inside[1:], [False]]) if len(data) else inside
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    powers, back = _power_tables(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, U), np.cumsum(BYTE[data] * powers[: len(data)], dtype=U)])
    return Words(data, offsets, start, end, np.searchsorted(offsets, start, "right") - 1, inside, sums, back)


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of each ``k``-word window; of fewer words, the whole sequence is one."""
    h, n = w.hashes(w.start, w.end), w.count()
    first = w.first()[:-1]
    with np.errstate(over="ignore"):
        if len(h) >= k:
            total = sum(mix(h[i : len(h) - k + 1 + i], i) * U(2 * i + 1) for i in range(k))
            whole = w.doc[: len(h) - k + 1] == w.doc[k - 1 :]
            out, doc = mix(total[whole], k), w.doc[: len(h) - k + 1][whole]
        else:
            out, doc = np.zeros(0, U), np.zeros(0, np.int64)
        short = np.flatnonzero((n > 0) & (n < k))
        if len(short):
            seq = np.zeros(len(short), U)
            for i in range(k - 1):
                has = n[short] > i
                seq[has] = mix(seq[has] + mix(h[first[short][has] + i], i), 100 + i)
            at = np.searchsorted(doc, short)
            out, doc = np.insert(out, at, mix(seq + n[short].astype(U), 99)), np.insert(doc, at, short)
    return out, doc


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch with about ``most`` bytes of text each."""
    size = np.diff(buffers(batch.column(text))[1])
    at, held = 0, 0
    for i, n in enumerate(size.tolist()):
        if i > at and held + n > most:
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += n
    if at < batch.num_rows:
        yield batch.slice(at)
    _give_back()


def _give_back() -> None:
    """Freed memory goes back to the system, since a worker outlives its tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass

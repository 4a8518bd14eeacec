"""Vectorised text primitives over Arrow string columns: words, word hashes, windows.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D. In UTF-8 every byte of a multi-byte
character is 0x80 or above, so this equals the code-point class ``[^\\x20\\x09-\\x0D]+``.
All hashes are 64 bits, seeded by rule (splitmix64), and depend on content only, so they agree
between executors, runs and machines.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Text bytes handled at once, to bound memory; a single longer text is still handled whole.
SLICE_BYTES = 1_000_000
U64 = np.uint64
#: By operator, what lets go of memory that it keeps in a Python worker from task to task.
KEPT: dict[str, Callable[[], None]] = {}


def give_back() -> None:
    """Memory that was freed goes back to the system, where the C library can do that; a worker lives on beside its executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # another C library
        return


def turn_to(operator: str) -> None:
    """A task of ``operator`` begins in this worker: what the others keep goes."""
    for name, let_go in KEPT.items():
        if name != operator:
            let_go()
    give_back()


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise on uint64."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """n pseudo-random uint64 of a seed."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=U64) + U64(seed * 1_000_003)) * U64(0x9E3779B97F4A7C15))


BYTE_CODES = stream(11, 256)
STEP = int(stream(12, 1)[0]) | 1
STEP_INVERSE = pow(STEP, -1, 2**64)
SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
POSITION_CODES = stream(13, 4096) | U64(1)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (STEP, STEP_INVERSE):
        p = np.full(n, base, dtype=U64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """STEP**0..n-1 and their inverses; one rounded-up size is kept."""
    size = SLICE_BYTES + 2
    return _powers(size) if n <= size else _powers.__wrapped__(n)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row ranges of a batch with about ``limit`` text bytes each."""
    if not batch.num_rows:
        return
    _, offsets = text_bytes(batch.column(batch.schema.get_field_index(column)))
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        stop = max(start + 1, min(stop, batch.num_rows))
        yield batch.slice(start, stop - start)
        start = stop


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and offsets (rows + 1). A null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


class Words:
    """The words of the texts of one slice.

    ``start``/``end`` are byte positions, ``doc`` the row of each word, ``first``/``count`` the
    words of each row, ``hash`` a 64-bit hash of each word's bytes.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, n = data, offsets, len(data)
        inside = ~SEPARATOR[data]
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets] = True
        left = inside.copy()
        left[1:] &= ~inside[:-1] | edge[1:n]
        right = inside
        if n > 1:
            right = inside.copy()
            right[:-1] &= ~inside[1:] | edge[1:n]
        self.start = np.flatnonzero(left)
        self.end = np.flatnonzero(right) + 1
        bounds = np.searchsorted(self.start, offsets)
        self.first, self.count = bounds[:-1], np.diff(bounds)
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.count)

    @property
    def hash(self) -> np.ndarray:
        if not hasattr(self, "_hash"):
            self._hash = span_hash(self.data, self.start, self.end)
        return self._hash

    def windows(self, k: int, limit_by: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every run of k consecutive words of one row (or with equal ``limit_by``)."""
        owner = self.doc if limit_by is None else limit_by
        n = len(owner) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, U64)
        total = np.zeros(n, dtype=U64)
        for t in range(k):
            total += self.hash[t : t + n] * POSITION_CODES[t]
        at = np.flatnonzero(owner[:n] == owner[k - 1 :])
        return at, mix(total[at])


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span: a polynomial over random byte codes, then mixed with the length."""
    if not len(start):
        return np.zeros(0, dtype=U64)
    up, down = powers(len(data) + 1)
    sums = np.empty(len(data) + 1, dtype=U64)
    sums[0] = 0
    np.cumsum(BYTE_CODES[data] * up[: len(data)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


def windows_hash(codes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive codes, by prefix sums: for long windows."""
    if len(codes) < k:
        return np.zeros(0, dtype=U64)
    up, down = powers(len(codes) + 1)
    sums = np.empty(len(codes) + 1, dtype=U64)
    sums[0] = 0
    np.cumsum(codes * up[: len(codes)], out=sums[1:])
    n = len(codes) - k + 1
    return mix((sums[k:] - sums[:n]) * down[:n])


def characters(data: np.ndarray) -> np.ndarray:
    """True where a code point begins."""
    return (data & 0xC0) != 0x80


def prefix_counts(flags: np.ndarray) -> np.ndarray:
    """sums[i] is the number of true flags before i."""
    out = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=out[1:])
    return out

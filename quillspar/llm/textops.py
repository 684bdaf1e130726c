"""Vectorised text primitives shared by the text operators.

Everything works on the UTF-8 bytes of a whole Arrow column at once: words are
runs of bytes of a class, and a word's 64-bit value comes from one polynomial
prefix sum over the column, so no per-word Python object is ever made.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)

#: Bytes handled at once; a longer single text is handled alone.
CHUNK_BYTES = (2 << 20) - 64

_pow = np.ones(1, U64)
_inv = np.ones(1, U64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base and its inverse, each raised to 0..n-1 modulo 2**64."""
    global _pow, _inv
    if len(_pow) < n:
        size = -(-n >> 16) << 16
        grown = []
        for base in (_BASE, _INVERSE):
            out = np.ones(1, U64)
            step = base
            while len(out) < size:
                out = np.concatenate([out, out * U64(step)])
                step = step * step & _MASK
            grown.append(out[:size].copy())
        _pow, _inv = grown
    return _pow[:n], _inv[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the public splitmix64 constants)."""
    x = np.array(x, U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    width = np.int64 if large else np.int32
    at = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


#: How to drop what tasks keep in a worker for their like.
LEFT: list[Callable[[], None]] = []


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES, rows: int = 1 << 30, keep: bool = False) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of about ``limit`` bytes of ``column`` and at most ``rows`` rows.

    What other operators' tasks left in this worker goes first, unless ``keep``.
    """
    for forget in () if keep else LEFT:
        forget()
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, at = utf8(batch.column(batch.schema.get_field_index(column)))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(at, at[start] + limit, "right")) - 1
            end = min(max(end, start + 1), start + rows, batch.num_rows)
            yield batch.slice(start, end - start)
            start = end
    give_back()


@lru_cache(1)
def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:
        return None


def give_back() -> None:
    """Return freed memory to the system: a worker lives on between tasks."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc(), "malloc_trim"):
        _libc().malloc_trim(0)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Separators: space and the five ASCII controls 09-0D.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Digits, a-z and every byte of a character past U+007F; used after lower-casing.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = True
ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True


def lower(raw: np.ndarray) -> np.ndarray:
    return _LOWER[raw]


class Words:
    """Words of a column of texts: byte bounds, the text of each, 64-bit values.

    ``first[d]:first[d + 1]`` are the words of text ``d``.
    """

    def __init__(self, raw: np.ndarray, at: np.ndarray, kind: np.ndarray, seed: int = 0):
        n = len(raw)
        inside = kind[raw]
        begins, ends = inside.copy(), inside.copy()
        if n:
            begins[1:] &= ~inside[:-1]
            ends[:-1] &= ~inside[1:]
            edge = at[1:-1]
            edge = edge[(edge > 0) & (edge < n)]
            begins[edge] = inside[edge]
            ends[edge - 1] = inside[edge - 1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, at)
        self.raw, self.at, self.seed = raw, at, seed

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.at) - 1), self.count)

    def values(self) -> np.ndarray:
        return span_values(self.raw, self.start, self.end, self.seed)


def span_values(raw: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit values of byte spans; equal spans have equal values anywhere."""
    up, down = powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, U64)
    np.cumsum((raw.astype(U64) + U64(1)) * up[:-1], out=total[1:])
    value = (total[end] - total[start]) * down[start]
    return mix(value ^ ((end - start).astype(U64) * U64(0xD6E8FEB86659FD93)) ^ U64(seed))


def grams(values: np.ndarray, first: np.ndarray, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Values of runs of k words inside one text, and the index of each run's first word."""
    n = len(values)
    if n < k:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    out = np.zeros(n - k + 1, U64)
    for j in range(k):
        out *= U64(_BASE)
        out += values[j : n - k + 1 + j]
    whole = np.ones(n - k + 1, bool)
    for j in range(1, k):
        cut = first[1:-1] - j
        cut = cut[(cut >= 0) & (cut < len(whole))]
        whole[cut] = False
    index = np.flatnonzero(whole)
    return mix(out[index] ^ U64((k * 0xA24BAED4963EE407 + seed) & _MASK)), index


def texts(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[str]:
    data = raw.tobytes()
    return [data[a:b].decode("utf-8", "replace") for a, b in zip(start.tolist(), end.tolist())]


def crc32_text(column: str):
    """crc32 of an id written as text, as the contracts' folds use it."""
    from pyspark.sql import functions as F

    return F.crc32(F.col(column).cast("string").cast("binary"))

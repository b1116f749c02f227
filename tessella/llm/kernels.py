"""Vectorised text kernels on Arrow string batches, used inside Spark tasks.

A word is a run of bytes other than space and \\x09-\\x0D. Words are hashed by a polynomial over a fixed
random byte table modulo 2**64, so all words of a slice are hashed with a few numpy passes. Equal words
have equal hashes; unequal ones collide with a chance near 2**-64 per pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SLICE_BYTES = 1 << 20
_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 1 << 63, size=256, dtype=np.uint64) * U64(2) + U64(1)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POSITION = _RNG.integers(1, 1 << 63, size=64, dtype=np.uint64) * U64(2) + U64(1)
WHITE = np.zeros(256, dtype=bool)
WHITE[[32, 9, 10, 11, 12, 13]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse up to n, kept for the slice size only."""
    size = max(n + 1, SLICE_BYTES + 1)
    found = _powers.get(size)
    if found is None:
        up = np.full(size, _BASE, dtype=np.uint64)
        down = np.full(size, _INVERSE, dtype=np.uint64)
        up[0] = down[0] = 1
        found = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        if size == SLICE_BYTES + 1:
            _powers[size] = found
    return found


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@dataclass
class Words:
    """Words of a slice: byte bounds, hash and row of each; first[r]:first[r + 1] are the words of row r."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    row: np.ndarray
    first: np.ndarray


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes of text; a longer text stands alone."""
    sizes = np.asarray(pc.binary_length(column).fill_null(0), dtype=np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        base = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield at, stop
        at = stop


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string array; null counts as empty."""
    column = column.fill_null("") if column.null_count else column
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = column.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8)[offsets[0] : offsets[-1]] if body is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def split(column: pa.Array, lower: bool = False) -> Words:
    data, offsets = raw(column)
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(data, offsets, none, none, none.astype(np.uint64), none, np.zeros(len(offsets), np.int64))
    solid = ~WHITE[data]
    opens = np.zeros(n + 1, dtype=bool)
    opens[offsets[:-1]] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = solid[:-1]
    start = np.flatnonzero(solid & (~before | opens[:n]))
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = solid[1:]
    closes = np.zeros(n + 1, dtype=bool)
    closes[offsets[1:]] = True
    end = np.flatnonzero(solid & (~after | closes[1:])) + 1
    up, down = powers(n)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((_LOWER if lower else _BYTE)[data] * up[:n], out=total[1:])
    hashed = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    row = np.searchsorted(offsets, start, side="right") - 1
    first = np.searchsorted(start, offsets, side="left")
    return Words(data, offsets, start, end, hashed, row, first)


def windows(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word windows inside rows, and the index of each window's first word."""
    n = len(words.hash) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = words.row[:n] == words.row[k - 1 :]
    out = words.hash[:n] * _POSITION[0]
    for j in range(1, k):
        out = out + words.hash[j : j + n] * _POSITION[j]
    at = np.flatnonzero(inside)
    return mix(out[at]), at


def shingle_sets(words: Words, k: int) -> Iterator[np.ndarray]:
    """Of each row, its distinct k-word shingles as sorted hashes; fewer words count as one shingle, none as no shingle."""
    hashes, at = windows(words, k)
    owner = words.row[at]
    bounds = np.searchsorted(owner, np.arange(len(words.first)), side="left")
    for r in range(len(words.first) - 1):
        lo, hi = bounds[r], bounds[r + 1]
        if hi > lo:
            yield np.unique(hashes[lo:hi])
        else:
            few = words.hash[words.first[r] : words.first[r + 1]]
            yield mix((few * _POSITION[: len(few)]).sum(dtype=np.uint64, keepdims=True) + U64(len(few))) if len(few) else few


def lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """A list column from one array per row."""
    sizes = np.fromiter((len(p) for p in parts), dtype=np.int64, count=len(parts))
    offsets = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum(sizes, out=offsets[1:])
    values = np.concatenate(parts) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(kind.to_pandas_dtype()), type=kind))

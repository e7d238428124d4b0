"""Vectorised byte-level text primitives for Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit (splitmix64)."""
    x = np.asarray(x, U64) + U64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


BYTE_VALUE = mix(np.arange(256)) | U64(1)
LOWER_VALUE = BYTE_VALUE[LOWER]
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 19)
        out = []
        for base in (_BASE, _BASE_INV):
            x = np.full(size, U64(base), U64)
            x[0] = 1
            out.append(np.cumprod(x, dtype=U64))
        if size > 1 << 20:  # not kept, so that one long document doesn't hold memory
            return out[0], out[1]
        _POWERS[:] = out
    return _POWERS[0][:n], _POWERS[1][:n]


def prefix_hash(data: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of the weighted bytes before each position; n + 1 of them."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, U64)
    np.cumsum(values[data] * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of data[start:end], the same wherever those bytes stand."""
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start])


def as_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string or binary column and n + 1 offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        kind = np.int32
    else:
        kind = np.int64
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    _, where, data = column.buffers()
    if len(column) == 0 or where is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(where, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents of about `most` bytes; a longer document stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+` of documents that lie one after another, A-Z lower-cased.

    Returns a 64-bit hash of each word, n + 1 offsets of documents in words, and the
    words' first and last + 1 byte."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return np.zeros(0, U64), np.zeros(len(offsets), np.int64), none, none
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    solid = ~WHITE[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:-1]
    last[:-1] &= ~solid[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashes = span_hash(prefix_hash(data, LOWER_VALUE), start, end)
    return hashes, np.searchsorted(start, offsets).astype(np.int64), start, end


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """An ordered combination of two arrays of hashes."""
    return mix((a * U64(0xD6E8FEB86659FD93)) ^ ((b << U64(23)) | (b >> U64(41))))


def group_index(offsets: np.ndarray) -> np.ndarray:
    """For each item the index of the group that holds it."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))

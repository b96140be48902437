"""Vectorised word kernels over Arrow string columns.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D. Those bytes never occur
inside a multi-byte UTF-8 character, so all work is done on the column's bytes. A word's
64-bit hash takes its length and then eight bytes at a time, mixed bijectively at each step;
a run's hash is the sum of its words' by unrelated odd factors. Hashes of two seeds make 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text that one slice of a batch holds, unless a single text is longer.
SLICE = 4 << 20
_STEP = 0x9E3779B97F4A7C15 | 1


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: What is left of eight bytes that hold the last 0 to 8 of a word.
_LAST = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)
#: Blocks of eight bytes that are hashed for all words at once; the rest of longer ones is hashed word by word.
_BLOCKS = 16


@cache
def _odd(length: int, seed: int) -> np.ndarray:
    """Unrelated odd factors, one for each place in a run."""
    return mix64(np.arange(1, length + 1, dtype=U64) * U64(_STEP) + mix64(np.array([seed + 1], U64))) | U64(1)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def raw(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offs


def slices(offs: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about `most` bytes each, one row at least."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + most, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of the texts between offs: (start, end) as byte positions, and bounds: text i has words bounds[i]:bounds[i+1]."""
    a, b = int(offs[0]), int(offs[-1])
    solid = ~_SPACE[data[a:b]]
    start = solid.copy()
    start[1:] &= ~solid[:-1]
    end = solid.copy()
    end[:-1] &= ~solid[1:]
    inner = offs[1:-1]
    inner = inner[(inner > a) & (inner < b)] - a
    start[inner] |= solid[inner]
    end[inner - 1] |= solid[inner - 1]
    s = np.flatnonzero(start) + a
    e = np.flatnonzero(end) + (a + 1)
    return s, e, np.searchsorted(s, offs)


def word_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray, *, lower: bool, seed: int = 0) -> np.ndarray:
    """64 bits for each word data[s:e]; those of two seeds are independent of each other."""
    if not len(s):
        return np.zeros(0, U64)
    first, n = int(s[0]), int(e[-1] - s[0])
    held = np.zeros(n + 8, np.uint8)
    held[:n] = _LOWER[data[first : first + n]] if lower else data[first : first + n]
    eight = np.ndarray((n + 1,), "<u8", held, strides=(1,))
    at, left = s - first, e - s
    out = mix64(left.astype(U64) * U64(_STEP) + mix64(np.array([seed + 1], U64)))
    out = mix64(out ^ (eight[at] & _LAST[np.minimum(left, 8)]))
    more = np.flatnonzero(left > 8)
    for k in range(1, _BLOCKS):
        if not len(more):
            return out
        now = left[more] - 8 * k
        out[more] = mix64(out[more] ^ (eight[at[more] + 8 * k] & _LAST[np.minimum(now, 8)]))
        more = more[now > 8]
    for i in more.tolist():
        rest = held[at[i] + 8 * _BLOCKS : at[i] + left[i]].tobytes()
        out[i] ^= U64(int.from_bytes(hashlib.blake2b(rest, digest_size=8, salt=seed.to_bytes(4, "little")).digest(), "little"))
    return out


def sequence_hashes(words: np.ndarray, bounds: np.ndarray, length: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `length` words that lie within one text, and bounds by text.

    The value at a run's start depends on the words' order, not on the place.
    """
    n = len(words)
    size = np.diff(bounds)
    runs = np.maximum(size - length + 1, 0)
    out_bounds = np.concatenate([[0], np.cumsum(runs)])
    if n < length:
        return np.zeros(0, U64), out_bounds
    acc = np.zeros(n - length + 1, U64)
    for k, factor in enumerate(_odd(length, seed)):
        acc += words[k : n - length + 1 + k] * factor
    keep = np.zeros(n + 1, np.int8)
    has = runs > 0
    np.add.at(keep, bounds[:-1][has], 1)
    np.add.at(keep, bounds[1:][has] - length + 1, -1)
    inside = np.cumsum(keep[: n - length + 1], dtype=np.int32) > 0
    return mix64(acc[inside]), out_bounds


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Concatenated ranges start[i] : start[i] + size[i]."""
    total = int(size.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
    return np.arange(total, dtype=np.int64) + shift


def binary_column(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """One binary value for each range of a fixed-width array."""
    values = np.ascontiguousarray(values)
    offsets = (np.asarray(bounds, np.int64) * values.itemsize).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values)]).cast(pa.binary())


def from_binary(column: pa.Array | pa.ChunkedArray, dtype: type) -> tuple[np.ndarray, np.ndarray]:
    """The values of a binary column laid end to end, and each row's bounds."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return np.zeros(0, dtype), np.zeros(1, np.int64)
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    flat = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return np.frombuffer(flat.tobytes(), dtype), (offs - offs[0]) // np.dtype(dtype).itemsize

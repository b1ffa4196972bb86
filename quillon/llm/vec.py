"""Array kernels over whole Arrow batches of texts.

A batch of texts is one UTF-8 byte buffer and an offsets array; words, shingles and hashes
of all its texts come from a few passes of NumPy over that buffer. The word separators are
the ASCII characters 0x20 and 0x09-0x0D, which never occur inside a multi-byte UTF-8
sequence, so bytes can be classified one at a time.

Null texts count as empty everywhere in this module.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

try:
    _libc = ctypes.CDLL("libc.so.6")
except OSError:  # not a GNU system
    _libc = None
U64 = np.uint64
CHUNK_BYTES = 1 << 21

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_BYTE_CODE = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64)
_SECOND_CODE = np.random.default_rng(20240502).integers(1, 1 << 63, 256, dtype=np.uint64)
_pow = np.ones(1, U64)
_inv = np.ones(1, U64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        size = max(n, 1 << 16)
        _pow = np.cumprod(np.concatenate([np.ones(1, U64), np.full(size - 1, _BASE, U64)]), dtype=U64)
        _inv = np.cumprod(np.concatenate([np.ones(1, U64), np.full(size - 1, _BASE_INV, U64)]), dtype=U64)
    return _pow[:n], _inv


def trim() -> None:
    """Gives memory that this process has freed back to the system: workers are kept, and one large block would else count for all later ones."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser (splitmix64) of each element."""
    x = x + U64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of whole texts of about `limit` bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    if column.null_count:
        column = column.fill_null("")
    _, raw, data = column.buffers()
    offs = np.frombuffer(raw, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offs, offs[row] + limit, "right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end, data[offs[row] : offs[end]], offs[row : end + 1] - offs[row]
        row = end
    if offs[n] - offs[0] > limit:
        trim()


def lower(buf: np.ndarray) -> np.ndarray:
    """A-Z to a-z, other bytes as they are."""
    return _LOWER[buf]


def word_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words before each text and in all) of the maximal runs of non-separators."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    is_word = ~_SPACE[buf]
    cut = offs[1:-1]
    cut = cut[(cut > 0) & (cut < len(buf))]
    first = is_word.copy()
    first[1:] &= ~is_word[:-1]
    first[cut] = is_word[cut]
    last = is_word
    last = last.copy()
    last[:-1] &= ~is_word[1:]
    last[cut - 1] = is_word[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, second: bool = False) -> np.ndarray:
    """A 64-bit hash of each span of bytes, the same wherever the span stands; second: another one."""
    power, inverse = _powers(len(buf) + 1)
    prefix = np.zeros(len(buf) + 1, U64)
    np.cumsum((_SECOND_CODE if second else _BYTE_CODE)[buf] * power[:-1], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(U64))


def gram_hashes(hashes: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams within each group (group g has elements bounds[g]:bounds[g+1]), and their bounds.

    A group of 1 to n-1 elements has one gram, its whole sequence; an empty group has none.
    """
    length = np.diff(bounds)
    made = np.where(length >= n, length - n + 1, (length > 0).astype(np.int64))
    out_bounds = np.concatenate([[0], np.cumsum(made)])
    total = int(out_bounds[-1])
    if not total:
        return np.zeros(0, U64), out_bounds
    at = np.arange(total) + np.repeat(bounds[:-1] - out_bounds[:-1], made)
    width = np.minimum(np.repeat(length, made), n)
    padded = np.concatenate([hashes, np.zeros(n, U64)])
    acc = width.astype(U64)
    for i in range(n):
        part = padded[at + i]
        if i:
            part = np.where(width > i, part, U64(0))
        acc = (acc + part) * U64(_BASE ^ (0x5851F42D4C957F2D & ~1))
        acc ^= acc >> U64(32)
    return mix(acc), out_bounds


def distinct_per_group(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each group's distinct values in ascending order, and their bounds."""
    group = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.argsort(values, kind="stable")
    order = order[np.argsort(group[order], kind="stable")]
    v, g = values[order], group[order]
    keep = np.ones(len(v), bool)
    keep[1:] = (v[1:] != v[:-1]) | (g[1:] != g[:-1])
    v, g = v[keep], g[keep]
    return v, np.searchsorted(g, np.arange(len(bounds)))


def shingle_sets(column: pa.Array, n: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, hashes, bounds): each text's set of n-word shingles, lower-cased in A-Z, ascending."""
    for row, end, buf, offs in text_chunks(column):
        buf = lower(buf)
        starts, ends, bounds = word_spans(buf, offs)
        grams, bounds = gram_hashes(span_hashes(buf, starts, ends), bounds, n)
        yield row, end, *distinct_per_group(grams, bounds)

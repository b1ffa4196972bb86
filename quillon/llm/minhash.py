"""One-permutation MinHash with optimal densification, and banded bucket keys.

A set's 64-bit hashes are split by value into `bins` equal ranges; a bin's signature is the least hash in
its range. An empty bin copies the signature of a bin that a fixed random order of bins, of its own, meets
first among the non-empty ones, so equal sets have equal signatures and each bin of two signatures agrees with
the probability of their Jaccard similarity.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from quillon.llm.vec import U64, mix


@lru_cache(maxsize=4)
def probe_order(bins: int) -> np.ndarray:
    """[attempt, bin]: the bin that an empty bin asks at an attempt; each bin's column is a permutation."""
    rng = np.random.default_rng(bins)
    return np.argsort(rng.random((bins, bins)), axis=0)


def signatures(values: np.ndarray, bounds: np.ndarray, bins: int) -> np.ndarray:
    """[set, bin] of sets given as ascending hashes; rows of empty sets hold zeros."""
    n = len(bounds) - 1
    group = np.repeat(np.arange(n), np.diff(bounds))
    at = ((values >> U64(32)) * U64(bins)) >> U64(32)
    slot = group * bins + at.astype(np.int64)
    first = np.ones(len(slot), bool)
    first[1:] = slot[1:] != slot[:-1]
    sig = np.zeros(n * bins, U64)
    full = np.zeros(n * bins, bool)
    sig[slot[first]] = values[first]
    full[slot[first]] = True
    return densified(sig.reshape(n, bins), full.reshape(n, bins))


def densified(sig: np.ndarray, full: np.ndarray) -> np.ndarray:
    """Signatures with their empty bins (not `full`) filled."""
    n, bins = sig.shape
    known, values, out = full.reshape(-1), sig.reshape(-1), sig.reshape(-1).copy()
    cell = np.flatnonzero(~(full | ~full.any(axis=1)[:, None]).reshape(-1))
    column = cell % bins
    first = cell - column
    for ask in probe_order(bins):
        if not len(cell):
            break
        at = first + ask[column]
        hit = known[at]
        out[cell[hit]] = values[at[hit]]
        left = ~hit
        cell, column, first = cell[left], column[left], first[left]
    return out.reshape(n, bins)


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """[set, band]: a 64-bit key of each band of `rows` bins, different between bands."""
    n, bins = sig.shape
    bands = bins // rows
    part = sig[:, : bands * rows].reshape(n, bands, rows)
    odd = mix(np.arange(rows, dtype=U64), 3) | U64(1)
    key = np.broadcast_to(mix(np.arange(bands, dtype=U64), 7), (n, bands)).copy()
    for i in range(rows):
        key += part[:, :, i] * odd[i]
    return mix(key)


def set_digests(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each set, the same for equal sets only (up to chance of 2^-128)."""
    out = []
    for salt in (11, 12):
        total = np.concatenate([np.zeros(1, U64), np.cumsum(mix(values, salt), dtype=U64)])
        out.append(mix(total[bounds[1:]] - total[bounds[:-1]] + np.diff(bounds).astype(U64), salt))
    return out[0], out[1]


def parities(values: np.ndarray, bounds: np.ndarray, words: int) -> np.ndarray:
    """`words` * 64 bits of each set, in a row: each element turns one bit over, by its hash. The bits in which two sets
    differ are at most as many as the elements that only one of them has."""
    return parity_bits(bit_slots(values, words), bounds, words)


def bit_slots(values: np.ndarray, words: int) -> np.ndarray:
    """Which of `words` * 64 bits each element turns over."""
    return (((mix(values, 14) >> U64(32)) * U64(64 * words)) >> U64(32)).astype(np.int64)


def parity_bits(slots: np.ndarray, bounds: np.ndarray, words: int) -> np.ndarray:
    """`words` words for each set: the bits that an odd number of the set's slots names. Counted for 2^23 bits at a time."""
    n, bits = len(bounds) - 1, 64 * words
    out = np.zeros(n * words, U64)
    step = max(1, (1 << 23) // bits)
    for i in range(0, n, step):
        j = min(n, i + step)
        # A count that passes 255 starts at 0 again and so stays as even or odd as it was.
        counts = np.zeros((j - i) * bits, np.uint8)
        np.add.at(counts, slots[bounds[i] : bounds[j]] + np.repeat(np.arange(j - i) * bits, np.diff(bounds[i : j + 1])), np.uint8(1))
        out[i * words : j * words] = np.packbits(counts & 1, bitorder="little").view("<u8")
    return out

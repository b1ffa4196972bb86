"""Hash keys dealt by ranges of their value, in packed arrays."""

from __future__ import annotations

import struct

import numpy as np

U64 = np.uint64


def range_cuts(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where ascending keys go from one of `parts` equal ranges to the next."""
    part = ((keys >> U64(32)) * U64(parts)) >> U64(32)
    return np.searchsorted(part, np.arange(parts + 1))


def pack_keys(keys: np.ndarray, part: int, parts: int) -> bytes:
    """48 bits of each key within its range, as differences in as few bytes as the largest needs."""
    low = U64(-(-(part << 32) // parts) << 32)
    short = (keys - low) >> U64(max(0, 16 - parts.bit_length() + 1))
    diff = np.diff(short, prepend=U64(0))
    width = max(1, (int(diff.max()).bit_length() + 7) // 8)
    body = np.ascontiguousarray(diff.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width])
    return struct.pack("<B", width) + body.tobytes()


def pack_unordered(keys: np.ndarray, part: int, parts: int) -> bytes:
    """The same 48 bits of keys in any order, six bytes each."""
    low = U64(-(-(part << 32) // parts) << 32)
    short = (keys - low) >> U64(max(0, 16 - parts.bit_length() + 1))
    return b"\0" + np.ascontiguousarray(short.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpack_keys(raw: bytes) -> np.ndarray:
    """The keys again, in the order in which they were packed, as they are told apart within their range."""
    width = raw[0]
    if not width:
        full = np.zeros(((len(raw) - 1) // 6, 8), np.uint8)
        full[:, :6] = np.frombuffer(raw, np.uint8, offset=1).reshape(-1, 6)
        return full.view("<u8").reshape(-1)
    body = np.frombuffer(raw, np.uint8, offset=1).reshape(-1, width)
    full = np.zeros((len(body), 8), np.uint8)
    full[:, :width] = body
    return np.cumsum(full.view("<u8").reshape(-1), dtype=U64)

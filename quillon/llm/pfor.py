"""Patched frame-of-reference coding of unsigned 32-bit ids.

A segment is little-endian: magic, documents (u32), ids (u64), blocks (u32); ids of each document (u32 each); then for
each block its start in the body (u64), its least id (u32), its width (u8) and its exceptions (u16); then the body.
A block of 512 ids is the low `width` bits of id - least, packed into 64-bit words by runs of 64 ids, followed by
its exceptions: their places (u16 each) and their whole id - least (u32 each). The width is that of the
`percentile` of the block's differences, so a few large ids don't widen a block. The last block is padded.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"QPF1"
BLOCK = 512
_HEAD = struct.Struct("<4sIQI")


def _bit_length(x: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(x.astype(np.float64) + 1)).astype(np.uint8)


def _pack(low: np.ndarray, width: int) -> np.ndarray:
    """[run, 64] values under 2^width to [run, width] words."""
    v = np.ascontiguousarray(low.astype(np.uint64).T)
    out = np.zeros((width, low.shape[0]), np.uint64)
    for i in range(64):
        word, shift = divmod(i * width, 64)
        out[word] |= v[i] << np.uint64(shift)
        if shift + width > 64:
            out[word + 1] |= v[i] >> np.uint64(64 - shift)
    return out.T


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    w = np.ascontiguousarray(words.T)
    out = np.empty((64, words.shape[0]), np.uint32)
    mask = np.uint64((1 << width) - 1)
    for i in range(64):
        word, shift = divmod(i * width, 64)
        v = w[word] >> np.uint64(shift)
        if shift + width > 64:
            v = v | (w[word + 1] << np.uint64(64 - shift))
        out[i] = (v & mask).astype(np.uint32)
    return out.T


def encode(ids: np.ndarray, doc_lengths: np.ndarray, percentile: float = 90.0) -> bytes:
    """A segment of the ids of documents, one after another; sum(doc_lengths) == len(ids)."""
    ids = ids.astype(np.uint32)
    blocks = -(-len(ids) // BLOCK)
    padded = np.empty(blocks * BLOCK, np.uint32)
    padded[: len(ids)] = ids
    if blocks:
        padded[len(ids) :] = ids[-1]
    grid = padded.reshape(blocks, BLOCK)
    base = grid.min(axis=1) if blocks else np.zeros(0, np.uint32)
    diff = grid - base[:, None]
    rank = min(BLOCK - 1, int(BLOCK * percentile / 100))
    width = _bit_length(np.partition(diff, rank, axis=1)[:, rank]) if blocks else np.zeros(0, np.uint8)
    limit = (np.uint64(1) << width.astype(np.uint64))[:, None]
    patched = diff >= limit
    count = patched.sum(axis=1).astype(np.uint16)
    size = width.astype(np.int64) * (BLOCK // 8) + count.astype(np.int64) * 6
    start = np.concatenate([[0], np.cumsum(size)])
    body = np.zeros(int(start[-1]), np.uint8)
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        if w:
            low = diff[rows] & np.uint32((1 << w) - 1)
            words = _pack(low.reshape(-1, 64), w).astype("<u8").reshape(len(rows), -1)
            at = start[rows][:, None] + np.arange(w * BLOCK // 8)
            body[at] = np.ascontiguousarray(words).view(np.uint8).reshape(len(rows), -1)
    for row in np.flatnonzero(count).tolist():
        places = np.flatnonzero(patched[row])
        at = int(start[row]) + int(width[row]) * (BLOCK // 8)
        tail = places.astype("<u2").tobytes() + diff[row, places].astype("<u4").tobytes()
        body[at : at + len(tail)] = np.frombuffer(tail, np.uint8)
    return b"".join(
        [
            _HEAD.pack(MAGIC, len(doc_lengths), len(ids), blocks),
            np.asarray(doc_lengths).astype("<u4").tobytes(),
            start[:-1].astype("<u8").tobytes(),
            base.astype("<u4").tobytes(),
            width.tobytes(),
            count.astype("<u2").tobytes(),
            body.tobytes(),
        ]
    )


def decode(segment: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ids of each document) of a segment."""
    magic, docs, n, blocks = _HEAD.unpack_from(segment)
    if magic != MAGIC:
        raise ValueError("not a segment of ids")
    at = _HEAD.size
    fields = []
    for kind, k in (("<u4", docs), ("<u8", blocks), ("<u4", blocks), ("u1", blocks), ("<u2", blocks)):
        fields.append(np.frombuffer(segment, kind, k, at))
        at += k * np.dtype(kind).itemsize
    lengths, start, base, width, count = fields
    body = np.frombuffer(segment, np.uint8, offset=at)
    out = np.zeros((blocks, BLOCK), np.uint32)
    for w in np.unique(width).tolist():
        if w:
            rows = np.flatnonzero(width == w)
            raw = body[start[rows].astype(np.int64)[:, None] + np.arange(w * BLOCK // 8)]
            out[rows] = _unpack(raw.view("<u8").reshape(-1, w), w).reshape(len(rows), BLOCK)
    for row in np.flatnonzero(count).tolist():
        k, pos = int(count[row]), int(start[row]) + int(width[row]) * (BLOCK // 8)
        places = body[pos : pos + 2 * k].view("<u2") if pos % 2 == 0 else np.frombuffer(body[pos : pos + 2 * k].tobytes(), "<u2")
        out[row, places] = np.frombuffer(body[pos + 2 * k : pos + 6 * k].tobytes(), "<u4")
    out += base[:, None]
    return out.reshape(-1)[:n], lengths

"""Token-id output: byte-level BPE ids of whole texts in patched frame-of-reference segments.

The ids are those of the tokenizers library. A byte-level BPE encodes each pre-token by itself, so a worker
splits a batch into pre-tokens with array operations, hands each pre-token that it has not met to the library
once, and copies the ids of the others.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm import pfor, vec

_FILE = "part int, seq int, ids_before long, n_ids long, doc_ids array<long>, segment binary"
_SPACE, _LETTER, _NUMBER, _OTHER = 0, 1, 2, 3


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    import regex

    every = "".join(chr(i) if not 0xD800 <= i < 0xE000 else " " for i in range(0x110000))
    out = np.full(0x110000, _OTHER, np.uint8)
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = kind
    out[0xD800:0xE000] = _OTHER
    return out


_CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def pre_token_starts(codes: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Flags the first code point of each pre-token of texts codes[offs[i]:offs[i + 1]].

    The pre-tokens of byte-level BPE: contractions; runs of letters, of numbers and of other characters, each
    with one space before it; other white space.
    """
    n = len(codes)
    kind = _classes()[codes]
    fresh = np.zeros(n + 1, bool)
    fresh[offs[:-1]] = True
    fresh[n] = True
    head, fresh = fresh[:n], fresh[1:]
    before = np.empty(n, np.uint8)
    before[1:] = kind[:-1]
    before[:1] = 9
    before[head] = 9
    after = np.empty(n, np.uint8)
    after[:-1] = kind[1:]
    after[-1:] = 9
    after[fresh] = 9
    blank_before = np.zeros(n, bool)
    blank_before[1:] = codes[:-1] == 0x20
    blank_before[head] = False
    space = kind == _SPACE
    start = np.where(space, (before != _SPACE) | ((after != _SPACE) & (after != 9)), (kind != before) & ~blank_before)
    start |= head
    for at in np.flatnonzero((codes == 0x27) & start).tolist():
        end = int(offs[np.searchsorted(offs, at, "right")])
        rest = codes[at + 1 : min(at + 3, end)]
        word = "".join(map(chr, rest.tolist()))
        for c in _CONTRACTIONS:
            if word.startswith(c):
                start[at + 1 : at + 1 + len(c)] = False
                stop = at + 1 + len(c)
                if stop < end:
                    start[stop] = True if kind[stop] != _SPACE else start[stop]
                break
    return start


class PieceEncoder:
    """Ids of whole texts by the library, each distinct pre-token encoded once."""

    def __init__(self, path: str, most: int = 4_000_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.by_piece = (
            spec.get("normalizer") is None
            and pre.get("type") == "ByteLevel"
            and pre.get("use_regex", True)
            and not pre.get("add_prefix_space")
            and spec["model"].get("type") == "BPE"
            and not spec["model"].get("dropout")
        )
        self.special = [t["content"].encode() for t in spec.get("added_tokens", [])]
        self.most = most
        mark = self._ids("\n")
        self.mark = mark[0] if len(mark) == 1 else None
        self._clear()

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _clear(self) -> None:
        """Pieces met: two tables of (keys, ascending; first id in pool; number of ids), the second of late ones."""
        empty = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.tables = [empty, empty]
        self.pool = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def _encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each piece): all in one text of lines, unless a piece is or holds a line break."""
        if self.mark is not None and not any(p.isspace() or "\n" in p for p in pieces):
            ids = np.array(self._ids("\n".join([*pieces, ""])), np.uint32)
            ends = np.flatnonzero(ids == self.mark)
            if len(ends) == len(pieces):
                return ids[ids != self.mark], np.diff(ends, prepend=-1) - 1
        got = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        return np.array([i for ids in got for i in ids], np.uint32), np.array([len(ids) for ids in got], np.int64)

    def _add(self, keys: np.ndarray, pieces: list[str]) -> None:
        blank = np.array([p.isspace() or "\n" in p for p in pieces])
        for part in (np.flatnonzero(blank), np.flatnonzero(~blank)):
            if not len(part):
                continue
            flat, length = self._encode_pieces([pieces[i] for i in part.tolist()])
            while self.used + len(flat) > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
            self.pool[self.used : self.used + len(flat)] = flat
            self._merge(1, (keys[part], self.used + np.cumsum(length) - length, length))
            self.used += len(flat)
        if len(self.tables[1][0]) > 50_000 + len(self.tables[0][0]) // 4:
            late, self.tables[1] = self.tables[1], tuple(x[:0] for x in self.tables[1])
            self._merge(0, late)

    def _merge(self, level: int, more: tuple) -> None:
        both = [np.concatenate(pair) for pair in zip(self.tables[level], more, strict=True)]
        order = np.argsort(both[0], kind="stable")
        self.tables[level] = tuple(x[order] for x in both)

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first id in pool, number of ids, -1 if not met) of ascending keys."""
        start, length = np.zeros(len(keys), np.int64), np.full(len(keys), -1)
        for known, starts, lengths in self.tables:
            if len(known):
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                hit = known[at] == keys
                start[hit], length[hit] = starts[at[hit]], lengths[at[hit]]
        return start, length

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each text) of the texts buf[offs[i]:offs[i + 1]] in UTF-8."""
        raw = buf.tobytes()
        if not self.by_piece or any(s in raw for s in self.special):
            texts = [raw[a:b].decode() for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
            got = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            return np.fromiter((i for ids in got for i in ids), np.uint32), np.fromiter(map(len, got), np.int64, len(got))
        if not raw:
            return np.zeros(0, np.uint32), np.zeros(len(offs) - 1, np.int64)
        lead = np.flatnonzero((buf & 0xC0) != 0x80)
        codes = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
        char_offs = np.searchsorted(lead, offs)
        starts = np.flatnonzero(pre_token_starts(codes, char_offs))
        per_text = np.searchsorted(starts, char_offs)
        byte_starts = lead[starts]
        byte_ends = np.append(byte_starts[1:], len(buf))
        keys = vec.span_hashes(buf, byte_starts, byte_ends)
        distinct, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        if sum(len(t[0]) for t in self.tables) + len(distinct) > self.most:
            self._clear()
        start, length = self._find(distinct)
        new = np.flatnonzero(length < 0)
        if len(new):
            at = first[new]
            pieces = [raw[a:b].decode() for a, b in zip(byte_starts[at].tolist(), byte_ends[at].tolist(), strict=True)]
            self._add(distinct[new], pieces)
            start, length = self._find(distinct)
        start, length = start[inverse], length[inverse]
        total = np.concatenate([[0], np.cumsum(length)])
        take = np.repeat(start - total[:-1], length) + np.arange(total[-1])
        return self.pool[take], np.diff(total[per_text])


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """The worker's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def _with_end(ids: np.ndarray, lengths: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    return np.insert(ids, np.cumsum(lengths), end_id).astype(np.uint32), lengths + 1


def _encoded(path: str, end_id: int, percentile: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seq, before = encoder(path), TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            for row, end, buf, offs in vec.text_chunks(batch.column(1)):
                ids, lengths = _with_end(*enc.encode(buf, offs), end_id)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part], pa.int32()),
                        pa.array([seq], pa.int32()),
                        pa.array([before], pa.int64()),
                        pa.array([len(ids)], pa.int64()),
                        pa.ListArray.from_arrays(pa.array([0, end - row], pa.int32()), batch.column(0).slice(row, end - row)),
                        pa.array([pfor.encode(ids, lengths, percentile)], pa.binary()),
                    ],
                    ["part", "seq", "ids_before", "n_ids", "doc_ids", "segment"],
                )
                seq, before = seq + 1, before + len(ids)

    return run


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for doc_ids, segment, first in zip(batch.column(0), batch.column(1), batch.column(2).to_pylist(), strict=True):
            ids, lengths = pfor.decode(segment.as_py())
            raw, ends = memoryview(ids.astype("<u4")).cast("B"), np.cumsum(lengths, dtype=np.int64)
            starts = ends - lengths
            yield pa.RecordBatch.from_arrays(
                [
                    doc_ids.values,
                    pa.array(first + starts),
                    pa.array(lengths.astype(np.int64)),
                    pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.int64()),
                ],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def write_token_ids(
    docs: DataFrame, out: str, vocabulary: str, end_id: int = 0, percentile: float = 90.0, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Writes the ids of every whole text, each followed by end_id, in ascending id order, as files of segments in `out`.

    A null text counts as empty: its only id is end_id. Null ids come first. Rows that share an id follow one another
    in no set order. Texts are dealt by ranges of the id, so that each file holds a range. A table of files holds a
    row for each segment: part and seq (its place), ids_before (ids before it in its part), n_ids, doc_ids, segment.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ranged = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    ranged.mapInArrow(_encoded(vocabulary, end_id, percentile), _FILE).write.option("compression", "none").parquet(out)


def read_token_ids(spark: SparkSession, out: str) -> DataFrame:
    """The segments in `out` with first_id: the ids in all before the segment. One row for each part is broadcast."""
    files = spark.read.schema(_FILE).parquet(out)
    low = F.transform("doc_ids", lambda x: F.coalesce(x, F.lit(-(1 << 63))))
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"), F.min(F.array_min(low)).alias("least"))
    offset = F.sum("n").over(Window.orderBy("least", "part")) - F.col("n")
    parts = parts.select("part", offset.alias("part_first"))
    return files.join(F.broadcast(parts), "part").withColumn("first_id", F.col("part_first") + F.col("ids_before"))


def token_digests(segments: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, decoded from the segments."""
    return segments.select("doc_ids", "segment", "first_id").mapInArrow(
        _digests, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )

"""Benchmark decontamination by q-gram filtering and banded alignment.

An occurrence of an item of m characters with at most k edits shares m - q + 1 - k * q of its q-grams, and they lie
on diagonals (place in the text minus place in the item) at most k apart from that of its start. A text's q-grams are
looked up in the items' q-grams; hits are counted by item in overlapping bands of diagonals; a band that meets the
bound is a region, and a banded alignment of the whole item with the region decides. Characters are the bytes of the
normal form: A-Z and the Latin-1 capitals in lower case, and each run of white space as one space.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm import vec

Q = 12
HITS_AT_ONCE = 2_000_000
SPAN = "array<struct<item_id:long,first:long,last:long,edits:int>>"


def normal_form(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, place of each byte in the original) of texts in normal form."""
    b = vec.lower(buf)
    if len(b):
        wide = np.flatnonzero((b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] <= 0x9E) & (b[1:] != 0x97)) + 1
        b[wide] += 0x20
    space = vec._SPACE[b]
    b[space] = 0x20
    again = np.zeros(len(b), bool)
    again[1:] = space[1:] & space[:-1]
    heads = offs[:-1][offs[:-1] < len(b)]
    again[heads] = False
    kept = np.flatnonzero(~again)
    return b[kept], np.searchsorted(kept, offs), kept


def gram_keys(b: np.ndarray) -> np.ndarray:
    """A key of the q-gram at each place with Q bytes from there."""
    n = len(b) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    padded = np.concatenate([b, np.zeros(16, np.uint8)])
    word = np.empty(n + 4, np.uint64)
    for r in range(8):
        part = padded[r : r + (len(padded) - r) // 8 * 8].view("<u8")
        word[r::8] = part[: len(word[r::8])]
    return (word[:n] ^ (word[4 : n + 4] * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD1B54A32D192ED03)


FAR = 1 << 40


def _alignment(item: np.ndarray, region: np.ndarray, shift: int | None = None, width: int | None = None, most: int = FAR, anchored: bool = False) -> tuple[int, int]:
    """(edits, end in region) of the best alignment of the whole item in the region, within `width` diagonals from `shift` on.

    A diagonal is the place in the region minus that in the item. A row of the alignment has `width` columns, all by
    default; the alignment is given up, with FAR edits, once a row has none of at most `most` edits. anchored: it starts with the region.
    """
    shift = -len(item) if shift is None else shift
    width = len(item) + len(region) + 1 if width is None else width
    steps = np.arange(width)
    place = steps + shift  # in the region, of row 0
    inside = (place >= 0) & (place <= len(region))
    row = np.where(inside, place if anchored else 0, FAR)
    padded = np.concatenate([np.full(max(0, -shift) + 1, -1, np.int16), region.astype(np.int16), np.full(max(0, shift) + width + len(item) + 1, -1, np.int16)])
    first = shift + max(0, -shift)  # in padded, of the character before column 0 of row 0
    for i, ch in enumerate(item.tolist(), 1):
        before = padded[first + i : first + i + width]  # the character before each column of row i
        best = row + (before != ch)
        best[before < 0] = FAR
        best[:-1] = np.minimum(best[:-1], row[1:] + 1)
        at = place + i
        best[(at < 0) | (at > len(region))] = FAR
        row = np.minimum.accumulate(best - steps) + steps
        row[(at < 0) | (at > len(region))] = FAR
        if row.min() > most:
            return FAR, 0
    at = int(row.argmin())
    return int(row[at]), int(place[at]) + len(item)


def _counted(doc: np.ndarray, item: np.ndarray, band: np.ndarray, hits: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct (doc, item, band), in order, with the sums of their hits."""
    order = np.lexsort((band, item, doc))
    doc, item, band = doc[order], item[order], band[order]
    new = np.ones(len(order), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (band[1:] != band[:-1])
    first = np.flatnonzero(new)
    return doc[first], item[first], band[first], np.add.reduceat(hits[order], first) if len(first) else hits


@dataclass
class ItemIndex:
    """The q-grams of a block of items."""

    ids: list[int | None]
    texts: list[bytes]
    edits: np.ndarray
    needed: np.ndarray
    keys: np.ndarray
    item: np.ndarray
    place: np.ndarray
    short: list[int]

    @classmethod
    def build(cls, items: list[tuple[int, str]], rate: float) -> ItemIndex:
        ids, texts, edits, needed, keys, item, place, short = [], [], [], [], [], [], [], []
        for item_id, text in items:
            raw = np.frombuffer((text or "").encode(), np.uint8)
            form = normal_form(raw, np.array([0, len(raw)]))[0].tobytes().strip(b" ")
            if not form:
                continue
            m, i = len(form), len(ids)
            k = min(int(rate * m), max(0, (m - Q) // Q))
            ids.append(item_id), texts.append(form), edits.append(k), needed.append(m - Q + 1 - k * Q)
            if m < Q:
                short.append(i)
                continue
            got = gram_keys(np.frombuffer(form, np.uint8))
            keys.append(got), item.append(np.full(len(got), i)), place.append(np.arange(len(got)))
        cat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        key, it, pl = cat(keys, np.uint64), cat(item, np.int64), cat(place, np.int64)
        order = np.argsort(key, kind="stable")
        return cls(ids, texts, np.array(edits, np.int64), np.array(needed, np.int64), key[order], it[order], pl[order], short)

    def seen(self) -> np.ndarray:
        """Which leading bits of a key any key has: 64 places for each key, 64 MB at most."""
        bits = min(26, len(self.keys).bit_length() + 6)
        table = np.zeros(1 << bits, bool)
        table[(self.keys >> np.uint64(64 - bits)).astype(np.int64)] = True
        return table

    def _bands(self, p: np.ndarray, lo: np.ndarray, n: np.ndarray, offs: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
        """(text, item, band, hits) of the places p with n entries from lo each: every hit counts in two bands."""
        at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        p = np.repeat(p, n)
        item, doc = self.item[at], np.searchsorted(offs, p, "right") - 1
        band = (p - self.place[at] + size) // (self.edits[item] + 1)
        inside = p + Q <= offs[doc + 1]
        doc, item, band = (np.concatenate([x[inside], x[inside] - less]) for x, less in ((doc, 0), (item, 0), (band, 1)))
        return _counted(doc, item, band, np.ones(len(doc), np.int64))

    def search(self, b: np.ndarray, offs: np.ndarray, seen: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(text, item id, first, end, edits) of the occurrences in texts b[offs[i]:offs[i + 1]]."""
        found = []
        for i in self.short:
            raw, at = b.tobytes(), -1
            while (at := raw.find(self.texts[i], at + 1)) >= 0:
                doc = int(np.searchsorted(offs, at, "right")) - 1
                end = at + len(self.texts[i])
                whole = (at == offs[doc] or raw[at - 1] == 32) and (end == offs[doc + 1] or raw[end : end + 1] == b" ")
                if end <= offs[doc + 1] and whole:
                    found.append((doc, self.ids[i], at, end, 0))
        keys = gram_keys(b)
        p = np.flatnonzero(seen[(keys >> np.uint64(65 - len(seen).bit_length())).astype(np.int64)])
        lo = np.searchsorted(self.keys, keys[p], "left")
        n = np.searchsorted(self.keys, keys[p], "right") - lo
        p, lo, n = p[n > 0], lo[n > 0], n[n > 0]
        if not len(p):
            return found
        cuts = np.flatnonzero(np.diff(np.cumsum(n) // HITS_AT_ONCE, prepend=-1))
        parts = [self._bands(p[i:j], lo[i:j], n[i:j], offs, len(b)) for i, j in zip(cuts, [*cuts[1:], len(p)], strict=True)]
        doc, item, band, hits = parts[0] if len(parts) == 1 else _counted(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        taken: dict[tuple[int, int], int] = {}
        for f in np.flatnonzero(hits >= self.needed[item]).tolist():
            d, i, k = int(doc[f]), int(item[f]), int(self.edits[item[f]])
            width = k + 1
            low = int(band[f]) * width - len(b)
            if taken.get((d, i), -1 << 60) > low:
                continue  # the overlapping band before it gave this occurrence
            a = max(int(offs[d]), low - k)
            e = min(int(offs[d + 1]), low + 2 * width + len(self.texts[i]) + k)
            text = b[a:e]
            exact = text.tobytes().find(self.texts[i])
            if exact >= 0:
                found.append((d, self.ids[i], a + exact, a + exact + len(self.texts[i]), 0))
                taken[d, i] = a + exact + 1
                continue
            whole = np.frombuffer(self.texts[i], np.uint8)
            edits, end = _alignment(whole, text, low - k - a, 2 * width + 2 * k + 1, k)
            if edits <= k:
                back = _alignment(whole[::-1], text[max(0, end - len(whole) - k) : end][::-1], -k, 2 * k + 1, k, anchored=True)[1]
                found.append((d, self.ids[i], a + end - back, a + end, edits))
                taken[d, i] = a + end - back + width
        return found


def _search_udf(spark, index: ItemIndex):
    held = spark.sparkContext.broadcast(index)
    tables: dict = {}

    @F.arrow_udf(SPAN)
    def regions(text: pa.Array) -> pa.Array:
        ix = held.value
        if "seen" not in tables:
            tables["seen"] = ix.seen()
        out: list[list[dict]] = [[] for _ in range(len(text))]
        for row, _end, buf, offs in vec.text_chunks(text):
            b, at, kept = normal_form(buf, offs)
            for d, item, first, last, edits in ix.search(b, at, tables["seen"]):
                out[row + d].append(
                    {"item_id": item, "first": int(kept[first] - offs[d]), "last": int(kept[last - 1] + 1 - offs[d]), "edits": edits}
                )
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("edits", pa.int32())]))
        return pa.array([sorted(x, key=lambda s: (s["item_id"] is not None, s["item_id"] or 0, s["first"])) for x in out], kind)

    return regions


def regions_of(
    text: Column, items: DataFrame, rate: float = 0.06, item_id: str = "item_id", item_text: str = "text", block_chars: int = 1 << 22
) -> Column:
    """The occurrences of benchmark items in a text column, by item and place.

    An occurrence has at most rate * m edits of the item's m characters (fewer for items so short that the filter
    would not bound them: at most (m - 12) / 12; items under 12 characters are found as whole words only). first and
    last are byte offsets in the original text, last exclusive. Null and empty texts have no regions; null and empty
    items are nowhere; regions of items with a null id have a null item_id. The texts aren't shuffled. The items are sent to the executors in blocks of about `block_chars`
    characters, one after another if there are more: what is broadcast is bounded by that.
    """
    total = items.agg(F.sum(F.length(item_text))).first()[0] or 0
    blocks = -(-total // block_chars) or 1
    listed = items.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).cast("string").alias("t"))
    columns = []
    for block in range(blocks):
        part = listed.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == block) if blocks > 1 else listed
        index = ItemIndex.build(sorted({(r.i, r.t) for r in part.collect()}, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")), rate)
        columns.append(_search_udf(items.sparkSession, index)(text.cast("string")))
    return columns[0] if len(columns) == 1 else F.array_sort(F.concat(*columns))


def contamination(docs: DataFrame, items: DataFrame, rate: float = 0.06, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, contaminated, item_ids, n_regions, regions, kept) of each row of `docs`; kept is not contaminated."""
    rows = docs.select(F.col(id_col).alias("doc_id"), regions_of(F.col(text_col), items, rate).alias("regions"))
    return rows.select(
        "doc_id",
        (F.size("regions") > 0).alias("contaminated"),
        F.array_sort(F.array_distinct(F.transform("regions", lambda r: r["item_id"]))).alias("item_ids"),
        F.size("regions").alias("n_regions"),
        "regions",
        (F.size("regions") == 0).alias("kept"),
    )

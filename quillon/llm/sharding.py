"""Sharding by minimax contiguous partition of atomic groups.

DataFrame operations on the data, and a search on the driver over a table of fixed size. The atomic groups are the
equal texts, in the order of their MD5 (a fixed random order, so shards are also well mixed). The least feasible
shard capacity is found by binary search with greedy checks over the prefix sums of the group sizes. The driver
holds prefix sums of stretches of the order only: at first of the 4,096 stretches that share three hexadecimal
digits, then of finer stretches where a search step ended inside one, until every step that matters falls
between two groups. Nothing that the driver holds grows with the number of groups.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.scratch import written

FIRST_DIGITS, MORE_DIGITS = 3, 2
SLOT_ROWS = 1024


class Stretches:
    """Prefix sums of stretches of groups, made finer where they are asked for."""

    def __init__(self, groups: DataFrame):
        self.groups = groups
        self.items = self._sums(groups, FIRST_DIGITS)
        self.asked: set[int] = set()
        self._index()

    @staticmethod
    def _sums(groups: DataFrame, digits: int) -> list[tuple]:
        rows = (
            groups.groupBy(F.substring("g", 1, digits).alias("p"))
            .agg(F.sum("bytes"), F.count("*"), F.max("bytes"), F.max("g"))
            .collect()
        )
        return sorted(tuple(r) for r in rows)

    def _index(self) -> None:
        self.ends, total = [], 0
        for item in self.items:
            total += item[1]
            self.ends.append(total)
        self.total = total
        self.largest = max((item[3] for item in self.items), default=0)

    def at_most(self, x: int) -> int:
        """The greatest prefix sum that is x or less; a guess, noted for refining, if it lies inside a stretch."""
        i = bisect_right(self.ends, x)
        if i == len(self.items):
            return self.total
        before = self.ends[i - 1] if i else 0
        if self.items[i][2] == 1 or x == before:
            return before
        self.asked.add(i)
        return x

    def refine(self) -> bool:
        """Splits the stretches that were asked for; False if there were none."""
        asked, self.asked = self.asked, set()
        if not asked:
            return False
        by_length: dict[int, list[str]] = {}
        for i in asked:
            by_length.setdefault(len(self.items[i][0]), []).append(self.items[i][0])
        kept = [item for i, item in enumerate(self.items) if i not in asked]
        for length, prefixes in by_length.items():
            part = self.groups.where(F.substring("g", 1, length).isin(prefixes))
            kept += self._sums(part, length + MORE_DIGITS)
        self.items = sorted(kept)
        self._index()
        return True


def greedy(s: Stretches, capacity: int, shards: int) -> bool:
    """Whether filling each shard as far as it goes takes all groups."""
    at = 0
    for _ in range(shards):
        at = s.at_most(at + capacity)
    return at >= s.total


def _last_start(s: Stretches, capacity: int, shards: int) -> list[int]:
    """For each cut, the least prefix sum from which the later shards can still take the rest."""
    out, at = [], s.total
    for _ in range(shards - 1):
        low = at - capacity
        at = 0 if low <= 0 else (low if (found := s.at_most(low)) == low else _next(s, found))
        out.append(at)
    return out[::-1]


def _next(s: Stretches, x: int) -> int:
    """The first prefix sum after x."""
    i = bisect_right(s.ends, x)
    if i < len(s.items) and s.items[i][2] > 1:
        s.asked.add(i)
    return s.ends[i] if i < len(s.ends) else s.total


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[int, list[int], list[str]]:
    """(least capacity, cut positions, last group before each cut or '' for none) of groups (g string, bytes long).

    All partitions into contiguous shards have a shard of at least that capacity. The cuts keep to it and lie,
    as far as they can, where even shards would be cut.
    """
    s = Stretches(groups)
    while True:
        low, high = max(s.largest, -(-s.total // shards)), s.largest + -(-s.total // shards)
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if greedy(s, mid, shards) else (mid + 1, high)
        capacity, at, cuts = low, 0, []
        least = _last_start(s, capacity, shards)
        for i in range(shards - 1):
            even = at + -(-(s.total - at) // (shards - i))
            near = s.at_most(even)
            if near < even and (after := _next(s, near)) - even < even - near and after <= at + capacity:
                near = after
            at = max(near, at, least[i])
            cuts.append(at)
        if not s.refine():
            break
    names = []
    for cut in cuts:
        i = bisect_right(s.ends, cut) - 1
        names.append(s.items[i][4] if i >= 0 and cut > 0 else "")
    return capacity, cuts, names


def shard_rows(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, text_md5) of each row of `docs`.

    size is the UTF-8 bytes of the text plus 1. Rows of equal text stay in one shard; a null text counts as
    empty. law is 'bytes': the largest shard is as small as contiguous shards of whole groups allow. slot counts
    each shard's rows from 0 without gaps. grown_shard is null. With fewer groups than shards some shards are
    empty; without rows the result is empty. Ids may be null or repeat.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = written(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.md5(text).alias("g"),
        ),
        "shard-rows",
    )
    groups = written(rows.groupBy("g").agg(F.sum("size").alias("bytes")), "shard-groups")
    _, _, names = minimax_cuts(groups, shards)
    shard = sum((F.when(F.col("g") > F.lit(name), 1).otherwise(0) for name in names if name), F.lit(sum(not n for n in names)))
    placed = rows.withColumn("shard", shard.cast("int")).withColumn("part", F.substring("g", 1, FIRST_DIGITS))
    counts = placed.groupBy("part").agg(F.ceil(F.count("*") / SLOT_ROWS).alias("salts"))
    salted = placed.join(F.broadcast(counts), "part").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.col("salts")))
    salted = written(salted.drop("salts"), "shard-salted")
    bins = salted.groupBy("shard", "part", "salt").agg(F.count("*").alias("n"))
    parts = bins.groupBy("shard", "part").agg(F.sum("n").alias("part_n"))
    before_part = F.sum("part_n").over(Window.partitionBy("shard").orderBy("part")) - F.col("part_n")
    parts = parts.withColumn("before_part", before_part).drop("part_n")
    before_salt = F.sum("n").over(Window.partitionBy("shard", "part").orderBy("salt")) - F.col("n")
    first = bins.withColumn("before_salt", before_salt).join(parts, ["shard", "part"])
    first = first.select("shard", "part", "salt", (F.col("before_part") + F.col("before_salt")).alias("first"))
    within = F.row_number().over(Window.partitionBy("shard", "part", "salt").orderBy("g", "doc_id", "size"))
    return (
        salted.withColumn("within", within)
        .join(first, ["shard", "part", "salt"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("first") + F.col("within") - 1).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
            F.col("g").alias("text_md5"),
        )
    )

"""A bit table of ids, by which most rows of a large table are told to be outside a set without an exchange of the rows.

An id sets two bits of one 64-bit word. There are 16 bits for each id, 2^26 at most. The words are a table of at most
2^20 rows, which is broadcast, whatever the number of ids. Rows that the table can't rule out must be joined exactly; with
far more than 2^26 ids these are most rows. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.scratch import written

MOST_WORDS = 1 << 20
_WORD, _BITS = "_among_word", "_among_bits"


def _place(c: Column, words: int) -> tuple[Column, Column]:
    """(word, its bits) of an id."""
    h = F.xxhash64(c.cast("long"))
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63)).cast("int"))
    word = F.shiftrightunsigned(h, 40).bitwiseAND(F.lit(words - 1)).cast("int")
    return word, bit(h).bitwiseOR(bit(F.shiftright(h, 6)))


def marked(rows: DataFrame, ids: DataFrame, id_col: str = "id", mark: str = "_among", of: str = "id") -> DataFrame:
    """The rows with a boolean column, false only if their id is none of `ids`. Null is never among them. `ids` is read twice: write it first."""
    n = ids.count()
    words = min(MOST_WORDS, 1 << max(4, (n // 4).bit_length()))
    word, bits = _place(F.col(of), words)
    table = ids.where(F.col(of).isNotNull()).select(word.alias(_WORD), bits.alias(_BITS)).groupBy(_WORD).agg(F.bit_or(_BITS).alias(_BITS))
    word, bits = _place(rows[id_col], words)
    joined = rows.join(F.broadcast(written(table, "bit-table")), word == F.col(_WORD), "left")
    among = rows[id_col].isNotNull() & (F.coalesce(F.col(_BITS), F.lit(0).cast("long")).bitwiseAND(bits) == bits)
    return joined.withColumn(mark, among).drop(_WORD, _BITS)

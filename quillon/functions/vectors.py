"""Vector and score functions, as Column expressions over arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.text import col, tokens


def dot(a: Column | str, b: Column | str) -> Column:
    """The inner product, added up in order in double precision."""
    products = F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalized(a: Column | str, least: float = 1e-12) -> Column:
    n = F.greatest(norm(a), F.lit(least))
    return F.transform(col(a), lambda x: (x.cast("double") / n).cast("float"))


def cosine(a: Column | str, b: Column | str) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + 1e-12)


def mean_pool(hidden: Column | str, mask: Column | str) -> Column:
    """The mean of the rows of array<array> that the mask counts."""
    count = F.greatest(F.aggregate(col(mask), F.lit(0.0), lambda acc, m: acc + m.cast("double")), F.lit(1e-9))
    masked = F.zip_with(col(hidden), col(mask), lambda row, m: F.transform(row, lambda x: x.cast("double") * m.cast("double")))
    zero = F.transform(F.element_at(col(hidden), 1), lambda _: F.lit(0.0))
    total = F.aggregate(masked, zero, lambda acc, row: F.zip_with(acc, row, lambda x, y: x + y))
    return F.transform(total, lambda x: x / count)


def score_from_logits(logits: Column | str) -> Column:
    """One logit: sigmoid; two: softmax of the second; more: the greatest softmax. Without logits: an error."""
    x = col(logits)
    one = 1 / (1 + F.exp(-x[0].cast("double")))
    two = 1 / (1 + F.exp(x[0].cast("double") - x[1].cast("double")))
    most = F.array_max(x).cast("double")
    more = 1 / F.aggregate(x, F.lit(0.0), lambda acc, v: acc + F.exp(v.cast("double") - most))
    none = F.raise_error(F.lit("a score needs at least one logit")).cast("double")
    return F.when(F.size(x) == 1, one).when(F.size(x) == 2, two).when(F.size(x) > 2, more).otherwise(none)


def hashed_encoding(c: Column | str, dims: int = 64) -> Column:
    """A stand-in for a neural encoder: counts of hashed tokens, scaled to length 1. Deterministic, and inside the JVM."""
    slots = F.transform(tokens(F.coalesce(col(c), F.lit(""))), lambda t: F.pmod(F.xxhash64(t), F.lit(dims)))
    counts = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.size(F.filter(slots, lambda s: s == i)).cast("double"))
    return l2_normalized(counts)


def token_overlap(left: Column | str, right: Column | str) -> Column:
    """A stand-in for a neural pair scorer: the Jaccard similarity of the token sets, 0 if both are empty."""
    a, b = F.array_distinct(tokens(left)), F.array_distinct(tokens(right))
    both = F.size(F.array_intersect(a, b)).cast("double")
    return F.coalesce(both / F.nullif(F.size(F.array_union(a, b)), F.lit(0)), F.lit(0.0))


def as_flag(c: Column | str) -> Column:
    """1 from 0.5 on, 0 below, null for what isn't a number."""
    number = F.expr("try_cast(null as double)") if c is None else col(c).cast("string").try_cast("double")
    return F.when(number >= 0.5, 1).when(number.isNotNull(), 0)

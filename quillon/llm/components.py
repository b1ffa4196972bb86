"""Connected components of a distributed graph: union-find within bounded pieces, then alternating stars over all."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.scratch import forget, written


PIECE = 200_000


def _forest(a: list[int], b: list[int]) -> dict[int, int]:
    """Each node of the edges and the least node of its component, by union-find."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for x, y in zip(a, b, strict=True):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return {x: root(x) for x in parent}


def _stars_of_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a: list[int] = []
    b: list[int] = []

    def star() -> pa.RecordBatch:
        links = [(x, top) for x, top in _forest(a, b).items() if x != top]
        return pa.RecordBatch.from_arrays(
            [pa.array([x for x, _ in links], pa.int64()), pa.array([top for _, top in links], pa.int64())], ["a", "b"]
        )

    for batch in batches:
        a += batch.column(0).to_pylist()
        b += batch.column(1).to_pylist()
        if len(a) >= PIECE:
            yield star()
            a, b = [], []
    if a:
        yield star()


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    linked = both.join(least, "a").where("b > a and b <> m")
    return linked.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    moved = e.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def _is_star_forest(e: DataFrame) -> bool:
    ends = e.select(F.col("a").alias("v"), F.lit(1).alias("out"), F.lit(0).alias("center")).union(
        e.select(F.col("b").alias("v"), F.lit(0).alias("out"), F.lit(1).alias("center"))
    )
    each = ends.groupBy("v").agg(F.sum("out").alias("out"), F.max("center").alias("center"))
    return each.where("out > 1 or (out = 1 and center = 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of edges (a, b): component is the least node reachable. A written table.

    Nodes are longs. Every step is joins and aggregations that combine before they shuffle; no node's
    neighbours are gathered in one place; union-find runs on pieces of `PIECE` edges or so. Edges with a null end, and loops, are ignored.
    """
    links = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    e = written(links.hint("rebalance").mapInArrow(_stars_of_pieces, "a long, b long").distinct(), "stars")
    while not _is_star_forest(e):
        large = written(_large_star(e), "stars")
        forget(e)
        e = written(_small_star(large), "stars")
        forget(large)
    centers = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    labels = written(e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(centers), "components")
    forget(e)
    return labels

"""Connected components of a link table by local forests and alternating star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from emberlog.llm.common import salted_join
from emberlog.session import cut_lineage

#: Links that one task contracts together.
AT_ONCE = 500_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces links by stars that connect the same nodes, ``AT_ONCE`` links at a time."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    def stars() -> pa.RecordBatch:
        pairs = [(x, root(x)) for x in parent]
        pairs = [(x, r) for x, r in pairs if x != r]
        parent.clear()
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([r for _, r in pairs], pa.int64())], ["u", "v"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > 2 * AT_ONCE:
            yield stars()
    if parent:
        yield stars()


def _least_neighbour(pairs: DataFrame) -> DataFrame:
    """``pairs (u, v)`` with ``m``, the least of ``u`` and its neighbours; partial minima meet, so a hub costs a row per task."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return salted_join(pairs, least, ["u"], F.col("v"), "inner").withColumn("m", F.least("u", "m"))


def _state(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every end of ``links (a, b)``; a component is named by its least node.

    Tasks first contract the links they hold.  Then each round links the larger neighbours of a node to the least one (large
    star) and the smaller ones as well (small star) until nothing changes; the number of rounds grows with the
    logarithm of the longest path.  Rounds are written tables.
    """
    links = cut_lineage(links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    edges = cut_lineage(links.coalesce(links.count() // AT_ONCE + 1).mapInArrow(_forest, "u bigint, v bigint"))
    seen = _state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least_neighbour(both).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut_lineage(large.filter(F.col("u") != F.col("v")))
        small = _least_neighbour(large)
        edges = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        edges = cut_lineage(edges.filter(F.col("u") != F.col("v")).distinct())
        state = _state(edges)
        if state == seen:
            break
        seen = state
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)

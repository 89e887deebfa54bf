"""Distance joins in crowded frames: an adaptive grid over places.

Frames usually hold a few points, and an equality join by session and frame compares them all.  Where a frame holds more than
``CROWD`` points, both sides are dealt to the cells of a grid as wide as the reach: a point stays in its own cell, points of the other
side are copied to the neighbouring cells too, so every pair within reach meets exactly once and no task holds a whole frame.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, functions as F

from emberlog.session import cut_lineage

#: Points of the copied side that may share a key before the key is cut into cells.
CROWD = 256


def by_cell(left: DataFrame, right: DataFrame, keys: list[str], own: list[str], other: list[str], reach: float, crowd: int = CROWD) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides of a join on ``keys`` whose rows pair up only if no coordinate of ``own`` and ``other`` differs by more than ``reach``.

    Returns them with further key columns (none if no key is crowded).  Keys are counted first; the crowded ones are a table.
    """
    points = right.groupBy(*keys).agg(F.count("*").alias("_points"))
    if (points.agg(F.max("_points")).first()[0] or 0) <= crowd:
        return left, right, []
    mark = cut_lineage(points.filter(F.col("_points") > crowd).select(*keys, F.lit(True).alias("_crowded")))
    names = [f"_cell{i}" for i in range(len(own))]

    def cell(column: str) -> Column:
        return F.floor(F.col(column) / reach)

    left = left.join(mark, keys, "left").withColumns({n: F.when(F.col("_crowded"), cell(c)).otherwise(0) for n, c in zip(names, own, strict=True)})
    around = F.array(*[F.struct(*[(cell(c) + s).alias(n) for n, c, s in zip(names, other, shift, strict=True)]) for shift in product((-1, 0, 1), repeat=len(other))])
    alone = F.array(F.struct(*[F.lit(0).cast("bigint").alias(n) for n in names]))
    right = right.join(mark, keys, "left").withColumn("_spot", F.explode(F.when(F.col("_crowded"), around).otherwise(alone)))
    right = right.withColumns({n: F.col(f"_spot.{n}") for n in names})
    return left.drop("_crowded"), right.drop("_crowded", "_spot"), names

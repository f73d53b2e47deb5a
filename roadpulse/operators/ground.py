"""Ground cells: the sphere cut into cubes as wide as the radius spans.

Two places within the radius lie in the same cube or in ones that touch, at the
poles and across the date line like anywhere else. Cells that hold rows form a
graph whose size follows from the ground covered, not from the number of rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadpulse.functions.geo import EARTH_MILES, SLACK, number
from roadpulse.session import cut_lineage

CELL = ["gx", "gy", "gz"]


def cell_side(radius: float) -> float:
    """Straight line across the radius on the unit sphere, with room for rounding."""
    return 2 * math.sin(min(radius / (2 * EARTH_MILES), math.pi / 2)) * SLACK + 1e-14


def with_ground_cell(df: DataFrame, radius: float) -> DataFrame:
    """Adds the cell every row lies in."""
    side = number(cell_side(radius))
    at = {
        "gx": f"floor(cos(radians(lat)) * cos(radians(lon)) / {side})",
        "gy": f"floor(cos(radians(lat)) * sin(radians(lon)) / {side})",
        "gz": f"floor(sin(radians(lat)) / {side})",
    }
    return df.withColumns({c: F.expr(e) for c, e in at.items()})


def occupied(placed: DataFrame, keys: list[str]) -> DataFrame:
    """The cells in use, with their rows."""
    return placed.groupBy(*keys, *CELL).agg(F.count(F.lit(1)).alias("n"))


def _touching(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of ids (u < v) of cells that touch."""
    steps = [
        (x, y, z)
        for x in (-1, 0, 1)
        for y in (-1, 0, 1)
        for z in (-1, 0, 1)
        if (x, y, z) > (0, 0, 0)
    ]
    step = F.explode(F.array(*[F.struct(*[F.lit(s).alias(c) for s, c in zip(t, "xyz")]) for t in steps]))
    there = cells.select("id", *keys, *CELL, step.alias("s"))
    for c, s in zip(CELL, "xyz"):
        there = there.withColumn(c, F.col(c) + F.col(f"s.{s}"))
    other = cells.select(F.col("id").alias("other"), *keys, *CELL)
    pairs = there.join(other, [*keys, *CELL])
    return pairs.select(F.least("id", "other").alias("u"), F.greatest("id", "other").alias("v"))


def components(edges: DataFrame) -> DataFrame:
    """(v, u) of every node v that is not the smallest of its component, with
    that smallest one, from edges u < v. Stars are contracted in turn: the larger
    neighbours of a node go to its smallest neighbour, then the smaller ones,
    until only stars around the smallest are left: rounds follow the logarithm
    of the longest path."""
    edges = cut_lineage(edges.filter("u < v").distinct())
    size = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = edges.join(least, "u").select(F.col("m").alias("u"), "v").distinct()
        lowest = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(lowest, "v")
        hung = small.select(F.col("m").alias("u"), "v").unionByName(
            small.filter("u != m").select(F.col("m").alias("u"), F.col("u").alias("v"))
        )
        after = cut_lineage(hung.distinct())
        # Stars around the smallest stay as they are.
        now = after.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long"))).first()
        if tuple(now) == size:
            return after
        edges, size = after, tuple(now)


def assign_ground_islands(points: DataFrame, radius: float, keys: list[str]) -> DataFrame:
    """Adds `part_id`: places with different ones are never within the radius,
    and those of one are joined by cells that touch. Only cells, not rows, take
    part in the search."""
    placed = with_ground_cell(points, radius)
    cells = occupied(placed, keys).withColumn("id", F.xxhash64(*keys, *CELL))
    cells = cut_lineage(cells)
    found = components(_touching(cells, keys)).select(F.col("v").alias("id"), "u")
    # Cells whose ids should collide would share an island, which is allowed.
    named = cells.join(found, "id", "left").select(*keys, *CELL, F.coalesce("u", "id").alias("part_id"))
    return placed.join(named, [*keys, *CELL]).drop(*CELL)

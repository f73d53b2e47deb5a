"""Islands: parts of a road so far apart that no incident of one can meet an
incident of another."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadpulse.functions.geo import EARTH_MILES, SLACK, band_height, lat_band, number


def island_bands(
    points: DataFrame, radius: float, keys: list[str], counted: str = "true"
) -> DataFrame:
    """Occupied latitude bands with the island each belongs to, the number of
    rows that are `counted`, and how far from the equator the island goes.

    A band is one radius high, so a gap wider than the radius can only lie
    between two occupied bands: the points fold into bands first, and the
    window then sees at most 180 degrees' worth of bands per road, whatever
    the number of points.
    """
    bands = (
        points.withColumn("band", F.expr(lat_band("lat", radius)))
        .groupBy(*keys, "band")
        .agg(
            F.min("lat").alias("low"),
            F.max("lat").alias("high"),
            F.count_if(F.expr(counted)).alias("band_rows"),
        )
    )
    w = Window.partitionBy(*keys).orderBy("band")
    gap = F.col("low") - F.lag("high").over(w) > F.lit(band_height(radius))
    opens = F.when(gap, F.lit(1)).otherwise(F.lit(0))
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    far = F.max(F.greatest(F.abs("low"), F.abs("high")))
    return (
        bands.withColumn("_opens", opens)
        .withColumn("island_id", F.sum("_opens").over(running).cast("int"))
        .withColumn("far", far.over(Window.partitionBy(*keys, "island_id")))
        .select(*keys, "band", "island_id", "band_rows", "far")
    )


def assign_islands(
    points: DataFrame, radius: float, keys: list[str] | None = None, bands: DataFrame | None = None
) -> DataFrame:
    """Adds `island_id`, numbered from 0 by latitude on each road."""
    keys = keys or ["road_key"]
    bands = bands if bands is not None else island_bands(points, radius, keys)
    at = points.withColumn("band", F.expr(lat_band("lat", radius)))
    return at.join(bands.drop("band_rows", "far"), [*keys, "band"]).drop("band")


def island_sizes(bands: DataFrame, keys: list[str] | None = None) -> DataFrame:
    keys = keys or ["road_key"]
    return bands.groupBy(*keys, "island_id").agg(
        F.sum("band_rows").cast("long").alias("island_rows")
    )


def assign_parts(
    points: DataFrame, radius: float, keys: list[str] | None = None, bands: DataFrame | None = None
) -> DataFrame:
    """Adds `island_id`, by latitude, and `part_id`, which cuts an island again
    where no longitude is occupied for as far as the radius spans at its latitude
    nearest a pole. A road that runs east-west, and a name that many towns use,
    comes apart here.

    Points fold into columns as wide as that span before the window, which so
    sees at most the columns around the globe. Where the first and the last part
    meet across the date line they are one.
    """
    keys = keys or ["road_key"]
    by = [*keys, "island_id"]
    bands = bands if bands is not None else island_bands(points, radius, keys)
    flattest = "greatest(cos(radians(far)), 1e-12D)"
    chord = number(math.sin(min(radius / (2 * EARTH_MILES), math.pi / 2)))
    width = f"degrees(asin(least({chord} / {flattest}, 1D))) * {number(2 * SLACK)}"
    bands = bands.selectExpr(*by, "band", f"{width} as _width")
    at = (
        points.withColumn("band", F.expr(lat_band("lat", radius)))
        .join(bands, [*keys, "band"])
        .drop("band")
        .withColumn("_x", F.expr("pmod(lon + 180D, 360D)"))
        .withColumn("_column", F.floor(F.col("_x") / F.col("_width")))
    )
    columns = at.groupBy(*by, "_column").agg(
        F.min("_x").alias("low"), F.max("_x").alias("high"), F.first("_width").alias("width")
    )
    w = Window.partitionBy(*by).orderBy("_column")
    whole = Window.partitionBy(*by)
    opens = F.when(F.col("low") - F.lag("high").over(w) > F.col("width"), 1).otherwise(0)
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = columns.withColumn("_opens", opens).withColumn("_part", F.sum("_opens").over(running).cast("int"))
    around = F.min("low").over(whole) + 360 - F.max("high").over(whole) <= F.col("width")
    last = F.col("_part") == F.max("_part").over(whole)
    parts = parts.withColumn("part_id", F.when(around & last, 0).otherwise(F.col("_part")))
    return at.join(parts.select(*by, "_column", "part_id"), [*by, "_column"]).drop(
        "_x", "_column", "_width"
    )


def part_sizes(placed: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return placed.groupBy(*(keys or ["road_key"]), "island_id", "part_id").agg(
        F.count(F.lit(1)).alias("part_rows")
    )

"""Geometry, and the grid that turns a distance join into an equi join.

The functions take column names or other SQL text and give SQL text, so that an
expression reaches Spark in one piece whatever its size; wrap it in `expr` to
get a Column.

The grid cuts the globe into latitude bands as high as the radius, and every
band into longitude cells at least as wide as the radius spans there. A point
lies in one cell; everything within the radius of it lies in the cells that
`explode_reach` gives it.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EARTH_MILES = 6372.8 / 1.609344  # fixed value
BEARING_LIMIT = 60  # fixed value, degrees, strictly below
SLACK = 1.0 + 1e-9


def number(x: float) -> str:
    """A double literal."""
    return f"{float(x)!r}D"


def road_key(road: str = "road") -> str:
    """Roads compare without regard to case; blanks count."""
    return f"lower(upper({road}))"


def same_road(a: str, b: str) -> str:
    return f"({road_key(a)} = {road_key(b)})"


def bearing_delta(a: str, b: str) -> str:
    """Circular difference in degrees, 0 to 180."""
    return f"abs(pmod(abs({a} - {b}) + 180, 360) - 180)"


def bearing_compatible(a: str, b: str) -> str:
    return f"({bearing_delta(a, b)} < {BEARING_LIMIT})"


def haversine_miles(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = (
        f"pow(sin(radians({lat2} - {lat1}) / 2D), 2D) + "
        f"pow(sin(radians({lon2} - {lon1}) / 2D), 2D) * cos(radians({lat1})) * cos(radians({lat2}))"
    )
    return f"(asin(sqrt({a})) * {number(2 * EARTH_MILES)})"


def gated_miles(a: dict[str, str], b: dict[str, str]) -> str:
    """Miles between two records on one road and in compatible directions,
    null otherwise. Each side maps road_key, bearing, lat and lon to text."""
    same = f"{a['road_key']} = {b['road_key']}"
    way = bearing_compatible(a["bearing"], b["bearing"])
    miles = haversine_miles(a["lat"], a["lon"], b["lat"], b["lon"])
    return f"case when {same} and {way} then {miles} end"


def side(alias: str) -> dict[str, str]:
    return {c: f"{alias}.{c}" for c in ("road_key", "bearing", "lat", "lon")}


def band_height(radius: float) -> float:
    """Degrees of latitude the radius spans, with room for rounding."""
    return math.degrees(radius / EARTH_MILES) * SLACK


def lat_band(lat: str, radius: float) -> str:
    return f"floor(({lat} + 90D) / {number(band_height(radius))})"


def _edge(band: str, radius: float) -> str:
    """Latitude of the lower edge of a band, kept within the poles."""
    return f"least(greatest(({band}) * {number(band_height(radius))} - 90D, -90D), 90D)"


def _flattest(low: str, high: str) -> str:
    """Smallest cosine of latitude between two latitudes."""
    return f"cos(radians(greatest(abs({low}), abs({high}))))"


def _width_ratio(band: str, radius: float) -> str:
    flattest = _flattest(_edge(f"{band} - 1", radius), _edge(f"{band} + 2", radius))
    return f"({number(math.sin(radius / (2 * EARTH_MILES)))} / {flattest})"


def lon_cell_count(ratio: str) -> str:
    """Cells in a band: as many as fit when each is as wide as the radius spans
    anywhere in the band or next to it, and one when fewer than three fit."""
    width = f"(degrees(asin({ratio})) * {number(2 * SLACK)})"
    limit = number(math.sin(math.radians(59.0)))
    return f"case when {ratio} < {limit} then floor(360D / {width}) else 1L end"


def lon_cell(lon: str, count: str) -> str:
    return f"least(floor(pmod({lon} + 180D, 360D) / 360D * {count}), {count} - 1)"


def with_cell(df: DataFrame, radius: float) -> DataFrame:
    """Adds the cell every row lies in."""
    return (
        df.withColumn("cell_y", F.expr(lat_band("lat", radius)))
        .withColumn("_ratio", F.expr(_width_ratio("cell_y", radius)))
        .withColumn("_count", F.expr(lon_cell_count("_ratio")))
        .withColumn("cell_x", F.expr(lon_cell("lon", "_count")))
        .drop("_ratio", "_count")
    )


def explode_reach(df: DataFrame, radius: float, miles: str | None = None) -> DataFrame:
    """One row for every cell of the grid of `radius` that can hold a point
    within that radius, or within `miles` (text, per row) where it is given: the
    small side of a distance join."""
    miles = miles or number(radius)
    half_angle = f"sin(least({miles} / {number(2 * EARTH_MILES)}, {number(math.pi / 2)}))"
    span = f"degrees({miles} / {number(EARTH_MILES)}) * {number(SLACK)}"
    flattest = _flattest(_edge("cell_y", radius), _edge("cell_y + 1", radius))
    reach = f"degrees(asin(least({half_angle} / sqrt(cos(radians(lat)) * {flattest}), 1D))) * 2D"
    whole = "_side * 2 + 1 >= _count"
    keep = df.columns
    return (
        df.selectExpr("*", f"{span} as _span")
        .selectExpr(
            *keep,
            f"explode(sequence({lat_band('(lat - _span)', radius)}, "
            f"{lat_band('(lat + _span)', radius)})) as cell_y",
        )
        .selectExpr("*", f"{_width_ratio('cell_y', radius)} as _ratio")
        .selectExpr("*", f"{lon_cell_count('_ratio')} as _count")
        .selectExpr(
            "*", f"{lon_cell('lon', '_count')} as _at", f"ceil({reach} * _count / 360D) as _side"
        )
        .selectExpr(
            *keep,
            "cell_y",
            "_count",
            f"explode(sequence(case when {whole} then 0L else _at - _side end, "
            f"case when {whole} then _count - 1 else _at + _side end)) as _x",
        )
        .selectExpr(*keep, "cell_y", "pmod(_x, _count) as cell_x")
    )

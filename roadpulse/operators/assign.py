"""Stage 1: match incidents to hot spots.

The hot spot side is copied into every grid cell it can reach, so that the
match is an equi join on (road, cell) with the direction and the distance as
residual conditions. How that side is shipped depends on its row count: at or
under the stated bound it is broadcast; above it, or when the count is not
known, the join shuffles and adaptive execution splits hot cells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadpulse.functions.fuzzy import effective_radius, membership
from roadpulse.functions.geo import (
    bearing_compatible,
    explode_reach,
    haversine_miles,
    number,
    road_key,
    with_cell,
)

CELL = ["road_key", "cell_y", "cell_x"]
POSITION = ["road_key", "lat", "lon", "bearing"]


def ship(small: DataFrame, rows: int | None, limit: int) -> DataFrame:
    """Broadcast only below the bound; above it ask for a sort-merge join, which
    spills and which adaptive execution can split."""
    if rows is None:
        return small
    return F.broadcast(small) if rows <= limit else small.hint("merge")


def hotspot_cells(
    hotspots: DataFrame,
    radius: float,
    rows: int | None = None,
    limit: int = 20_000,
    reach: str | None = None,
) -> DataFrame:
    """Hot spots by reachable cell of the grid of `radius`, columns prefixed so
    that both sides of the join stay apart. `reach` is a hot spot's own, in miles
    and in terms of `hs_sd`; without it all reach one radius."""
    side = hotspots.select(
        F.expr(road_key("road")).alias("road_key"),
        "lat",
        "lon",
        "hs_id",
        F.col("bearing").alias("hs_bearing"),
        *([F.col("sd").alias("hs_sd")] if "sd" in hotspots.columns else []),
    )
    cells = explode_reach(side, radius, reach)
    cells = cells.withColumnsRenamed({"lat": "hs_lat", "lon": "hs_lon"})
    return ship(cells, rows, limit)


MILES = haversine_miles("lat", "lon", "hs_lat", "hs_lon")
WAY = bearing_compatible("bearing", "hs_bearing")


def _join(incidents: DataFrame, cells: DataFrame, radius: float, how: str, gate: str):
    left, right = with_cell(incidents, radius).alias("i"), cells.alias("h")
    same_cell = " and ".join(f"i.{k} = h.{k}" for k in CELL)
    joined = left.join(right, F.expr(f"{same_cell} and {gate}"), how)
    if how == "left_anti":
        return joined.drop("cell_y", "cell_x")
    keep = [f"i.{c}" for c in incidents.columns]
    more = [f"h.{c}" for c in cells.columns if c not in CELL]
    return joined.selectExpr(*keep, *more)


def crisp_gate(radius: float) -> str:
    return f"{WAY} and {MILES} <= {number(radius)}"


def fuzzy_gate(max_miles: float, conf_threshold: float) -> str:
    m = membership(MILES, "hs_sd", max_miles)
    return f"{WAY} and {m} >= {number(conf_threshold)}"


def candidate_pairs(
    incidents: DataFrame,
    hotspots: DataFrame,
    radius: float,
    rows: int | None = None,
    limit: int = 20_000,
) -> DataFrame:
    """Every incident with every hot spot on its road, in its direction and
    within the radius."""
    cells = hotspot_cells(hotspots, radius, rows, limit)
    pairs = _join(incidents, cells, radius, "inner", crisp_gate(radius))
    return pairs.selectExpr("*", f"{MILES} as miles")


def road_pairs(
    incidents: DataFrame, hotspots: DataFrame, radius: float, rows: int | None = None
) -> DataFrame:
    """As `candidate_pairs` but whatever the direction."""
    cells = hotspot_cells(hotspots, radius, rows)
    pairs = _join(incidents, cells, radius, "inner", f"{MILES} <= {number(radius)}")
    return pairs.selectExpr("*", f"{MILES} as miles")


def _ranked(pick: str, miles: str, of: str) -> str:
    """Order of the candidates: nearest, ties to the lowest id; or the lowest id."""
    keys = [f"{miles} as miles", f"{of}hs_id as hs_id"]
    if pick == "first":
        keys.reverse()
    return f"struct({', '.join(keys)}, {of}hs_lat as hs_lat, {of}hs_lon as hs_lon)"


def assign_crisp(
    incidents: DataFrame,
    hotspots: DataFrame,
    radius: float,
    pick: str = "nearest",
    rows: int | None = None,
    limit: int = 20_000,
) -> DataFrame:
    """All incidents, each with the one hot spot it counts for (`hs_id`,
    `miles` and the hot spot's place), or nulls. Rows need no key: copies stay.

    Each cell's hot spots are packed into one array, from which every incident
    of the cell picks its own. With no more hot spots than the bound the arrays
    are broadcast and no incident moves. Beyond it, or when the number is not
    known, both sides are shuffled once by cell; adaptive execution splits a hot
    cell on the incident side. Hot spots lie apart, so an array stays short.
    """
    found = ("hs_id", "miles", "hs_lat", "hs_lon")
    known_small = rows is not None and rows <= limit
    best = _pick_from_cells(incidents, hotspots, radius, pick, known_small)
    return best.select(*incidents.columns, *[F.col(f"_best.{c}").alias(c) for c in found])


def _pick_from_cells(
    incidents: DataFrame, hotspots: DataFrame, radius: float, pick: str, in_place: bool
):
    cells = hotspot_cells(hotspots, radius)
    one = F.struct("hs_id", "hs_lat", "hs_lon", "hs_bearing")
    packed = cells.groupBy(*CELL).agg(F.collect_list(one).alias("_near"))
    packed = F.broadcast(packed) if in_place else packed.hint("merge")
    way = bearing_compatible("bearing", "h.hs_bearing")
    row = _ranked(pick, haversine_miles("lat", "lon", "h.hs_lat", "h.hs_lon"), "h.")
    ranked = f"transform(filter(_near, h -> {way}), h -> {row})"
    best = f"array_min(filter({ranked}, x -> x.miles <= {number(radius)})) as _best"
    joined = with_cell(incidents, radius).join(packed, CELL, "left")
    return joined.selectExpr(*incidents.columns, best)


def positions(incidents: DataFrame) -> DataFrame:
    """Incidents counted per road, place and bearing: what stage 1 decides on.
    Copies of one place fold on the map side, however many there are."""
    by = incidents.groupBy("road", *POSITION)
    return by.agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("seq"))


def tally(matched: DataFrame, fuzzy: bool = False) -> DataFrame:
    """Everything stage 1 hands on, in one aggregate: sums per hot spot place
    (`is_new` false) and, for rows without a match, per place, spelling and
    bearing. Both fold on the map side."""
    new = F.col("hs_id").isNull()
    n = F.col("n") if "n" in matched.columns else F.lit(1)
    own = {c: F.when(new, F.col(c)).alias(c) for c in ("road", "bearing")}
    sums = [F.sum(n).cast("long").alias("n"), F.min(F.when(new, F.col("seq"))).alias("seq")]
    if fuzzy:
        sums += [
            F.sum(F.col("membership") * n).alias("fit"),
            F.sum(F.col("miles") * n).alias("dist_sum"),
        ]
    return matched.groupBy(
        "road_key",
        F.coalesce("hs_lat", "lat").alias("lat"),
        F.coalesce("hs_lon", "lon").alias("lon"),
        new.alias("is_new"),
        *own.values(),
    ).agg(*sums)


def unassigned_incidents(
    incidents: DataFrame,
    hotspots: DataFrame,
    radius: float,
    rows: int | None = None,
    limit: int = 20_000,
) -> DataFrame:
    """Incidents no hot spot takes."""
    return _join(incidents, hotspot_cells(hotspots, radius, rows, limit), radius, "left_anti", crisp_gate(radius))


def split_assigned(assigned: DataFrame) -> tuple[DataFrame, DataFrame]:
    taken = F.col("hs_id").isNotNull()
    return assigned.filter(taken), assigned.filter(~taken)


def count_updates(assigned: DataFrame) -> DataFrame:
    """Incidents per hot spot."""
    n = F.sum("n") if "n" in assigned.columns else F.count(F.lit(1))
    taken = assigned.filter(F.col("hs_id").isNotNull())
    return taken.groupBy("hs_id").agg(n.cast("long").alias("n"))


def new_locations(unmatched: DataFrame) -> DataFrame:
    """Unmatched incidents counted per place on a road; the row with the lowest
    seq lends its spelling of the road and its bearing."""
    n = F.col("n") if "n" in unmatched.columns else F.lit(1)
    payload = F.min(F.struct("seq", "road", "bearing")).alias("_p")
    by = unmatched.groupBy("road_key", "lat", "lon").agg(
        F.sum(n).cast("long").alias("n"), payload
    )
    return by.select("_p.seq", "road_key", "_p.road", "lat", "lon", "_p.bearing", "n")


def _join_fuzzy(incidents, hotspots, max_miles, conf_threshold, rows, limit, how):
    """A hot spot takes what lies within its own reach, which follows from its
    spread, so it is copied into the cells of that reach only. The cells are half
    as wide as the largest reach: a narrow hot spot goes to one to four of them,
    the widest to some 35."""
    grid = max_miles / 2
    reach = effective_radius("hs_sd", max_miles, conf_threshold)
    cells = hotspot_cells(hotspots, grid, rows, limit, reach)
    return _join(incidents, cells, grid, how, fuzzy_gate(max_miles, conf_threshold))


def assign_fuzzy(
    incidents: DataFrame,
    hotspots: DataFrame,
    max_miles: float,
    conf_threshold: float,
    rows: int | None = None,
    limit: int = 20_000,
) -> DataFrame:
    """Every pair of an incident and a hot spot it belongs to well enough."""
    pairs = _join_fuzzy(incidents, hotspots, max_miles, conf_threshold, rows, limit, "inner")
    m = membership("miles", "hs_sd", max_miles)
    return pairs.selectExpr("*", f"{MILES} as miles").selectExpr("*", f"{m} as membership")


def unassigned_fuzzy(
    incidents: DataFrame,
    hotspots: DataFrame,
    max_miles: float,
    conf_threshold: float,
    rows: int | None = None,
    limit: int = 20_000,
) -> DataFrame:
    return _join_fuzzy(incidents, hotspots, max_miles, conf_threshold, rows, limit, "left_anti")


def match_fuzzy(
    incidents: DataFrame,
    hotspots: DataFrame,
    max_miles: float,
    conf_threshold: float,
    rows: int | None = None,
    limit: int = 20_000,
) -> DataFrame:
    """The pairs of `assign_fuzzy` and, with nulls, the incidents that have
    none: an incident meets all its candidates in its one cell, so the outer
    join tells both in one pass."""
    pairs = _join_fuzzy(incidents, hotspots, max_miles, conf_threshold, rows, limit, "left")
    m = membership("miles", "hs_sd", max_miles)
    return pairs.selectExpr("*", f"{MILES} as miles").selectExpr("*", f"{m} as membership")


def count_updates_fuzzy(pairs: DataFrame) -> DataFrame:
    """Sums of membership, incidents and miles per hot spot."""
    n = F.col("n") if "n" in pairs.columns else F.lit(1)
    return pairs.groupBy("hs_id").agg(
        F.sum(F.col("membership") * n).alias("fit"),
        F.sum(n).cast("long").alias("n_added"),
        F.sum(F.col("miles") * n).alias("dist_sum"),
    )

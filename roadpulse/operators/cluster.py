"""Stage 2: turn unmatched locations into new hot spot centres.

The rule, over the locations of a road in order of `seq`, then place: one that is already
a centre stays one; otherwise it joins the earliest centre before it within the
radius; otherwise it makes the next location within the radius a centre and
joins that; otherwise it is a centre of its own.

Two exact ways to get there, chosen by checked sizes. Groups of at most
`max_group_rows` locations go to a grouped function that reads them once in
order. Bigger ones are cut into blocks of ground, which are settled side by side
until they agree (`blocks`). Where ground is too dense for that, the order is
worked off in slices: joins first drop the locations of a slice that the centres
found so far already cover, and only the few that are left go to bounded groups
or blocks.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadpulse.functions.geo import (
    BEARING_LIMIT,
    bearing_compatible,
    explode_reach,
    haversine_miles,
    number,
    with_cell,
)
from roadpulse.operators import blocks, in_order
from roadpulse.operators.assign import ship
from roadpulse.operators.ground import assign_ground_islands
from roadpulse.operators.islands import (
    assign_islands,
    assign_parts,
    island_bands,
    island_sizes,
    part_sizes,
)
from roadpulse.session import cut_lineage

# Tasks get the helper along with the function, wherever the driver was started.
cloudpickle.register_pickle_by_value(in_order)

# What orders the locations of a road and names one of them: incident ids may
# repeat, places do not.
AT = ["seq", "lat", "lon"]
TO = ["to", "to_lat", "to_lon"]
BOUND = ["bound", "bound_lat", "bound_lon"]
OUT = ["hs_id", "road_key", "road", "lat", "lon", "bearing", "n", "n_added", "dist_sum", "lone"]


def greedy_cluster(
    points: DataFrame,
    radius: float,
    max_group_rows: int = 20_000,
    keys: list[str] | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Centres with the incidents (`n`), locations (`n_added`) and miles
    (`dist_sum`) they gathered.

    `points` holds seq, road_key, road, lat, lon, bearing, n, one row per place
    on a road. It is read several times, so hand in a persisted or written
    table. `keys` (the road by default) keep groups apart; `rows`, where the
    caller knows it, is an upper bound of their number.
    """
    keys = keys or ["road_key"]
    total = points.count() if rows is None or rows > max_group_rows else rows
    if total <= max_group_rows:
        return _grouped(points, radius, keys, keys, total)
    bands = cut_lineage(island_bands(points, radius, keys))
    sizes = island_sizes(bands, keys)
    small = F.col("island_rows") <= F.lit(max_group_rows)
    counts = sizes.agg(F.count_if(small).alias("s"), F.count_if(~small).alias("b")).first()
    if counts["b"] == 0:
        placed = assign_islands(points, radius, keys, bands)
        return _grouped(placed, radius, keys, [*keys, "island_id"], total)
    placed = assign_islands(points, radius, keys, bands).join(sizes, [*keys, "island_id"])
    out = _big_islands(placed.filter(~small).select(points.columns), radius, max_group_rows, keys)
    if counts["s"]:
        little = placed.filter(small)
        out = out.unionByName(_grouped(little, radius, keys, [*keys, "island_id"], total))
    return out


def _big_islands(points: DataFrame, radius: float, max_group_rows: int, keys: list[str]):
    """Islands that are too big by latitude alone, taken apart by the ground that
    is covered."""
    placed = cut_lineage(assign_ground_islands(points, radius, keys))
    by = [*keys, "part_id"]
    sizes = placed.groupBy(*by).agg(F.count(F.lit(1)).alias("part_rows"))
    placed = cut_lineage(placed.join(sizes, by))
    small = F.col("part_rows") <= F.lit(max_group_rows)
    counts = placed.agg(F.count_if(small).alias("s"), F.count_if(~small).alias("b")).first()
    out = []
    if counts["s"]:
        out.append(_grouped(placed.filter(small), radius, keys, by, counts["s"]))
    if counts["b"]:
        rest = placed.filter(~small).select(points.columns)
        out.append(cluster_in_rounds(rest, radius, max_group_rows, keys))
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


# --- bounded groups -----------------------------------------------------------


BATCH_ROWS = 5_000
# How much larger each slice of the order is than the one before.
GROWTH = 8
BROADCAST_ROWS = 20_000
# Points of a cell and slice of the order that a task call looks through at once.
SLICE_ROWS = 20_000
# Sides, in radii, of the cells looked through and of the patches that give bounds.
GRID, PATCH = 2.0, 2 / 3


def _in_batches(points: DataFrame, by: list[str], rows: int):
    """Groups hashed into batches, so that a task call serves many small groups
    and holds a few thousand rows. The number of partitions is set by the rows:
    by their bytes alone they would end up in very few tasks."""
    n = max(1, math.ceil(rows / BATCH_ROWS))
    if n > 10_000:
        n = max(10_000, math.ceil(rows / (10 * BATCH_ROWS)))
    at = points.withColumn("batch_id", F.pmod(F.xxhash64(*by), F.lit(n)).cast("int"))
    return at.repartition(n, "batch_id").groupBy("batch_id")


def _grouped(
    points: DataFrame, radius: float, keys: list[str], by: list[str], rows: int
) -> DataFrame:
    extra = [k for k in keys if k != "road_key"]
    cols = ["seq", "road_key", "road", "lat", "lon", "bearing", "n", *extra]
    types = dict(points.select(*cols).dtypes)
    schema = ", ".join(
        f"{name} {types.get(src, kind)}"
        for name, src, kind in [
            ("hs_id", "seq", ""),
            ("road_key", "road_key", ""),
            ("road", "road", ""),
            ("lat", "lat", ""),
            ("lon", "lon", ""),
            ("bearing", "bearing", ""),
            ("n", None, "bigint"),
            ("n_added", None, "bigint"),
            ("dist_sum", None, "double"),
            ("lone", None, "boolean"),
            *[(k, k, "") for k in extra],
        ]
    )

    out_cols = [*OUT, *extra]

    def centres(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([*by, *AT], ignore_index=True)
        target, miles, _ = in_order.settle_groups(pdf, by, radius)
        got = pd.DataFrame({"t": target, "n": pdf["n"], "m": miles}).groupby("t")
        out = got.agg(n=("n", "sum"), n_added=("n", "size"), dist_sum=("m", "sum"))
        rows = pdf.loc[out.index, ["seq", "road_key", "road", "lat", "lon", "bearing", *extra]]
        rows = rows.rename(columns={"seq": "hs_id"})
        rows = rows.assign(
            n=out["n"], n_added=out["n_added"], dist_sum=out["dist_sum"], lone=out["n_added"] == 1
        )
        return rows[out_cols]

    wanted = points.select(*dict.fromkeys([*by, *cols]))
    return _in_batches(wanted, by, rows).applyInPandas(centres, schema)


# --- groups of any size -------------------------------------------------------


def _miles(a: str, b: str) -> str:
    return haversine_miles(f"{a}.lat", f"{a}.lon", f"{b}.lat", f"{b}.lon")


def _near(a: str, b: str, radius: float) -> str:
    """Condition that rows of two aliased sides can meet."""
    way = bearing_compatible(f"{a}.bearing", f"{b}.bearing")
    return f"{way} and {_miles(a, b)} <= {number(radius)}"


def _before(a: str, b: str) -> str:
    """Condition that one aliased row comes before another in the order."""
    return f"struct({', '.join(f'{a}.{c}' for c in AT)}) < struct({', '.join(f'{b}.{c}' for c in AT)})"


def _reach(df: DataFrame, radius: float, rows: int | None) -> DataFrame:
    """The side of a distance join that is copied into cells, shipped by its
    row count."""
    return ship(explode_reach(df, radius), rows, BROADCAST_ROWS)


def _same(a: str, b: str, cols: list[str]) -> str:
    return " and ".join(f"{a}.{c} = {b}.{c}" for c in cols)


def first_later_neighbour(
    probes: DataFrame, points: DataFrame, radius: float, keys: list[str], rows: int | None = None
) -> DataFrame:
    """For every probe the next point after it within the radius, or nulls. Few
    probes (`rows`, where known) are broadcast to the points; many look ahead."""
    if rows is not None and rows <= BROADCAST_ROWS:
        pairs = _later_pairs(probes, points, radius, keys, rows)
    else:
        pairs = _pairs_ahead(probes, points, radius, keys)
    nxt = F.expr(f"struct(q.seq, q.lat, q.lon, q.bearing, {_miles('p', 'q')} as miles)")
    by = [F.col(f"p.{k}").alias(k) for k in [*keys, *AT]]
    best = pairs.groupBy(*by).agg(F.min(nxt).alias("next"))
    return probes.join(best, [*keys, *AT], "left")


def _later_pairs(probes: DataFrame, points: DataFrame, radius: float, keys: list[str], rows: int) -> DataFrame:
    """All pairs of a probe and a later point within the radius. The partial
    aggregate keeps one candidate per probe and task."""
    cells = [*keys, "cell_y", "cell_x"]
    reach = _reach(probes.select(*keys, "seq", "lat", "lon", "bearing"), radius, rows)
    later = f"{_same('p', 'q', cells)} and {_before('p', 'q')} and {_near('p', 'q', radius)}"
    return reach.alias("p").join(with_cell(points, radius).alias("q"), F.expr(later))


def _pairs_ahead(probes: DataFrame, points: DataFrame, radius: float, keys: list[str]) -> DataFrame:
    """For every probe the first later point within the radius of each slice of
    points that can hold the next one.

    A point after the probe on its own patch, in its direction, is a bound: the
    next one is no later. What lies between a probe and its bound in the cells it
    reaches is looked through in order. Where the probes are the points, a patch
    has one such span open at any place of the order, so a point is looked at by
    each patch in reach once, however dense the ground is. Cells that hold many
    points are cut into slices of the order."""
    cells = [*keys, "cell_y", "cell_x"]
    place = [*AT, "bearing"]
    told = " and ".join([f"{c} is not null" for c in [*keys, *place]] + ["not isnan(lat) and not isnan(lon)"])
    probe = probes.select(*keys, *place).filter(told)
    point = points.select(*keys, *place).filter(told)
    order = Window.partitionBy(*cells).orderBy(*AT)
    slice_id = F.floor((F.row_number().over(order) - 1) / F.lit(SLICE_ROWS))
    sliced = cut_lineage(with_cell(point, GRID * radius).withColumn("slice_id", slice_id))
    ends = sliced.groupBy(*cells, "slice_id").agg(F.min(F.struct(*AT)).alias("low"), F.max(F.struct(*AT)).alias("high"))
    reach = explode_reach(_bounded(probe, point, radius, keys), GRID * radius, number(radius))
    here = F.struct(*AT) < F.col("high")
    reach = reach.join(cut_lineage(ends), cells).filter(here & (~F.col("bounded") | (F.struct(*BOUND) >= F.col("low"))))
    group = F.xxhash64(*cells, "slice_id")
    n = min(10_000, max(1, math.ceil(sliced.count() / SLICE_ROWS)))
    at = [F.pmod(F.col("group_id"), F.lit(n)).cast("int").alias("batch_id"), "group_id", *keys, *place]
    spans = reach.withColumn("group_id", group).select(*at, "bounded", *BOUND).repartition(n, "batch_id")
    held = sliced.withColumn("group_id", group).select(*at).repartition(n, "batch_id")
    kinds = dict(held.dtypes)
    found = [*keys, *place, *[f"next_{c}" for c in place]]
    schema = ", ".join(f"{c} {kinds[c.removeprefix('next_')]}" for c in found)

    def look(spans: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        at, to = in_order.look_ahead(spans, held, keys, AT, BOUND, radius)
        out = spans[[*keys, *place]].take(at).reset_index(drop=True)
        there = held[place].take(to).reset_index(drop=True)
        return out.assign(**{f"next_{c}": there[c] for c in place})[found]

    pairs = spans.groupBy("batch_id").cogroup(held.groupBy("batch_id")).applyInPandas(look, schema)
    pairs = pairs.select(F.struct(*keys, *place).alias("p"), F.struct(*[F.col(f"next_{c}").alias(c) for c in place]).alias("q"))
    return pairs.filter(f"{_before('p', 'q')} and {_near('p', 'q', radius)}")


def _bounded(probe: DataFrame, point: DataFrame, radius: float, keys: list[str]) -> DataFrame:
    """Probes with a point after them within the radius, where their patch has one
    (`bounded`); other rows carry their own place instead. A patch is so small
    that what lies on it is within the radius, but the distance is checked."""
    both = probe.withColumn("is_point", F.lit(False)).unionByName(point.withColumn("is_point", F.lit(True)))
    way = F.floor(F.pmod(F.col("bearing"), F.lit(360)) / F.lit(BEARING_LIMIT)).alias("way")
    patch = with_cell(both, PATCH * radius).withColumn("way", way)
    later = Window.partitionBy(*keys, "cell_y", "cell_x", "way").orderBy(*[F.desc(c) for c in AT], "is_point")
    later = later.rowsBetween(Window.unboundedPreceding, -1)
    nxt = F.last(F.when(F.col("is_point"), F.struct(*AT, "bearing")), ignorenulls=True).over(later)
    rows = patch.withColumn("q", nxt).filter("not is_point").withColumn("p", F.struct(*AT, "bearing"))
    near = F.coalesce(F.expr(f"{_before('p', 'q')} and {_near('p', 'q', radius)}"), F.lit(False))
    rows = rows.withColumn("bounded", near)
    bound = [F.when(F.col("bounded"), F.col(f"q.{c}")).otherwise(F.col(c)).alias(b) for c, b in zip(AT, BOUND)]
    return rows.select(*keys, *AT, "bearing", "bounded", *bound)


def cluster_in_rounds(
    points: DataFrame,
    radius: float,
    max_group_rows: int = 20_000,
    keys: list[str] | None = None,
) -> DataFrame:
    """The same centres for groups of any size.

    Ground that can be cut into blocks of bounded size is settled block by
    block. Elsewhere the order is cut into slices, each `GROWTH` times as large as
    the one before. A location of a slice
    still matters for what becomes a centre only if no known centre before it
    lies within the radius, or if it is the first that such a one, or one that
    waits for its next neighbour, would call on. Those few form groups that
    cannot meet (islands of their own), or blocks, and are settled in order; the
    rest take the earliest centre before them at the end, in one join. A slice
    that puts too many in one group even so, waiting ones included, is halved,
    down to locations that share one `seq`. So every location is joined about once, and no group
    is above the bound as long as ids differ.
    """
    keys = keys or ["road_key"]
    points = cut_lineage(points)
    held = blocks.members(points, radius, keys, max_group_rows)
    if held is not None:
        placed = blocks.settle(held, keys, _in_batches, blocks.greedy_roles(radius))
        return _sum_up(points, placed.select(*keys, *AT, *TO, "miles"), keys)
    todo = _cuts(points, max_group_rows)
    found: list[DataFrame] = []
    waiting: DataFrame | None = None
    n_centres, n_waiting = 0, 0
    low = None
    while todo:
        high = todo.pop(0)
        part = points
        if low is not None and high is not None and high <= low:
            continue
        if low is not None:
            part = part.filter(F.col("seq") > F.lit(low))
        if high is not None:
            part = part.filter(F.col("seq") <= F.lit(high))
        fresh = cut_lineage(_fresh(part, found, waiting, radius, keys, n_centres, n_waiting))
        n_fresh = fresh.count()
        active, idle = fresh, None
        if waiting is not None:
            called_on, idle = _split_waiting(waiting, fresh, n_fresh, radius, keys)
            active = cut_lineage(fresh.unionByName(called_on.withColumn("covered", F.lit(False))))
        rows, held = active.count(), None
        if rows > max_group_rows:
            active, fits = _parted(active, radius, keys, max_group_rows)
            if not fits:
                held = blocks.members(active, radius, keys, max_group_rows, ["covered"])
            middle = None if fits or held is not None else _middle(fresh, n_fresh)
            if middle is not None:
                todo[:0] = [middle, high]
                continue
        if held is not None:
            out = blocks.settle(held, keys, _in_batches, blocks.greedy_roles(radius))
            out = _role_names(out, keys)
        else:
            out = _settle_slice(active, radius, keys, rows)
        out = cut_lineage(out)
        found.append(out.filter("role <> 'waiting'"))
        waiting = out.filter("role = 'waiting'")
        if idle is not None:
            waiting = cut_lineage(waiting.unionByName(idle))
        n_centres += out.filter("role = 'centre'").count()
        n_waiting = waiting.count()
        low = high
    return _gather(points, found, waiting, radius, keys, n_centres)


def _cuts(points: DataFrame, first: int) -> list:
    """Upper ends of the slices, the last one open. They come from a sample and
    steer only how much work a slice holds."""
    n = points.count()
    if n <= first:
        return [None]
    some = points.select("seq").sample(min(1.0, 20_000 / n), seed=7).collect()
    some = sorted(r[0] for r in some)
    cuts, share = [], first / n
    while share < 1.0 and some:
        at = some[min(int(share * len(some)), len(some) - 1)]
        if not cuts or at > cuts[-1]:
            cuts.append(at)
        share = share * GROWTH + first / n
    return [*cuts, None]


def _fresh(part, found, waiting, radius, keys, n_centres, n_waiting):
    """Locations of a slice that can still shape the outcome: the ones no known
    centre covers, and of the covered ones the first that any of these, or any
    that waits from before, would call on."""
    cells = [*keys, "cell_y", "cell_x"]
    cols = [*keys, "seq", "lat", "lon", "bearing"]
    part = part.select(*cols)
    if not found:
        return part.withColumn("covered", F.lit(False))
    at = with_cell(part, radius).alias("o")
    centres = _reach(_centres(found).select(*cols), radius, n_centres).alias("a")
    earlier = F.expr(f"{_same('a', 'o', cells)} and {_before('a', 'o')} and {_near('a', 'o', radius)}")
    free = cut_lineage(at.join(centres, earlier, "left_anti").select(*cols))
    covered = at.join(centres, earlier, "left_semi").select(*cols)
    callers = free.unionByName(waiting.select(*cols))
    n_callers = free.count() + n_waiting
    called = first_later_neighbour(callers, covered, radius, keys, n_callers)
    called = called.filter("next is not null")
    called = called.select(*keys, "next.seq", "next.lat", "next.lon", "next.bearing").distinct()
    return free.withColumn("covered", F.lit(False)).unionByName(
        called.withColumn("covered", F.lit(True))
    )


def _parted(active, radius, keys, max_group_rows):
    """What is to be settled with its groups, cut by longitude only where that is
    needed, and whether all of them are within the bound."""
    bands = island_bands(active, radius, keys)
    if island_sizes(bands, keys).agg(F.max("island_rows")).first()[0] <= max_group_rows:
        return assign_islands(active, radius, keys, bands).withColumn("part_id", F.lit(0)), True
    active = cut_lineage(assign_parts(active, radius, keys, bands))
    largest = part_sizes(active, keys).agg(F.max("part_rows")).first()[0]
    return active, largest <= max_group_rows


def _middle(fresh, n_fresh):
    """Where to cut a slice in two; nothing if all its rows share one place in
    the order."""
    some = fresh.select("seq").sample(min(1.0, 20_000 / max(n_fresh, 1)), seed=7).collect()
    some = sorted(r[0] for r in some)
    if some and some[0] < some[-1]:
        return some[(len(some) - 1) // 2]
    return None


def _split_waiting(waiting, fresh, n_fresh, radius, keys):
    """Waiting locations that a fresh one can reach, and the rest, which just go
    on waiting. Waiting ones lie more than the radius apart, so every fresh one
    brings in a handful at most."""
    cells = [*keys, "cell_y", "cell_x"]
    at = with_cell(waiting, radius).alias("o")
    reach = _reach(fresh, radius, n_fresh).alias("a")
    near = F.expr(f"{_same('a', 'o', cells)} and {_near('a', 'o', radius)}")
    near_cols = [*keys, "seq", "lat", "lon", "bearing"]
    called_on = at.join(reach, near, "left_semi").select(*near_cols)
    return called_on, at.join(reach, near, "left_anti").select(*waiting.columns)


def _settle_slice(grouped, radius, keys, rows):
    """Roles of the rows of a slice, group by group."""
    by = [*keys, "island_id", "part_id"] if "part_id" in grouped.columns else keys
    kinds = dict(grouped.dtypes)
    schema = ", ".join(
        [f"{k} {kinds[k]}" for k in [*keys, "seq", "lat", "lon", "bearing"]]
        + ["role string", f"to {kinds['seq']}", "to_lat double", "to_lon double", "miles double"]
    )
    names = [*keys, "seq", "lat", "lon", "bearing", "role", *TO, "miles"]

    def roles(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([*by, *AT], ignore_index=True)
        target, miles, role = in_order.settle_groups(pdf, by, radius, pdf["covered"].to_numpy())
        goal = {t: pdf[c].to_numpy()[target] for t, c in zip(TO, AT)}
        out = pdf.assign(**goal, miles=miles, role="settled")
        out.loc[target == out.index, "role"] = "waiting"
        out.loc[role == in_order.CENTRE, "role"] = "centre"
        return out.loc[target >= 0, names]

    return _in_batches(grouped, by, rows).applyInPandas(roles, schema)


def _role_names(placed, keys):
    """Rows of `blocks.settle` in the form of `_settle_slice`."""
    same = F.expr(" and ".join(f"{a} = {t}" for a, t in zip(AT, TO)))
    name = F.when(F.col("role") == in_order.CENTRE, "centre").when(same, "waiting").otherwise("settled")
    return placed.withColumn("role", name).select(*keys, "seq", "lat", "lon", "bearing", "role", *TO, "miles")


def _centres(found: list[DataFrame]) -> DataFrame:
    every = found[0]
    for df in found[1:]:
        every = every.unionByName(df)
    return every.filter("role = 'centre'")


def _gather(points, found, waiting, radius, keys, n_centres):
    """Adds every location to its centre. Locations that still wait have no
    neighbour left and are centres of their own."""
    cells = [*keys, "cell_y", "cell_x"]
    cols = [*keys, *AT, *TO, "miles"]
    fixed = waiting.select(*cols)
    for df in found:
        fixed = fixed.unionByName(df.select(*cols))
    centres = _centres(found).select(*keys, "seq", "lat", "lon", "bearing")
    rest = points.join(fixed, [*keys, *AT], "left_anti")
    near = f"{_same('c', 'o', cells)} and {_before('c', 'o')} and {_near('c', 'o', radius)}"
    goal = ", ".join(f"c.{c} as {t}" for t, c in zip(TO, AT))
    taken = (
        with_cell(rest, radius)
        .alias("o")
        .join(_reach(centres, radius, n_centres).alias("c"), F.expr(near))
        .groupBy(*[F.col(f"o.{k}").alias(k) for k in [*keys, *AT]])
        .agg(F.expr(f"min(struct({goal}, {_miles('c', 'o')} as miles))").alias("_b"))
        .select(*keys, *AT, "_b.*")
    )
    return _sum_up(points, fixed.unionByName(taken), keys)


def _sum_up(points, placed, keys):
    """Centres with what `placed` (one row per location) sends to them."""
    extra = [k for k in keys if k != "road_key"]
    sums = (
        points.select(*keys, *AT, "n")
        .join(placed, [*keys, *AT])
        .groupBy(*keys, *TO)
        .agg(
            F.sum("n").cast("long").alias("n"),
            F.count(F.lit(1)).alias("n_added"),
            F.sum("miles").alias("dist_sum"),
        )
    )
    return (
        points.drop("n")
        .withColumnRenamed("seq", "hs_id")
        .join(
            sums.withColumnsRenamed({"to": "hs_id", "to_lat": "lat", "to_lon": "lon"}),
            [*keys, "hs_id", "lat", "lon"],
        )
        .withColumn("lone", F.col("n_added") == 1)
        .select(*OUT, *extra)
    )


# --- two phases over buckets --------------------------------------------------


def with_bucket(points: DataFrame, n_buckets: int) -> DataFrame:
    """Bucket by a hash of the id, spread evenly whatever the ids look like."""
    digest = F.substring(F.md5(F.col("seq").cast("string")), 1, 8)
    number = F.conv(digest, 16, 10).cast("long")
    return points.withColumn("bucket_id", F.pmod(number, F.lit(n_buckets)).cast("int"))


def greedy_cluster_bucketed(
    points: DataFrame,
    radius: float,
    n_buckets: int = 8,
    max_group_rows: int = 20_000,
    compat_counts: bool = False,
    rows: int | None = None,
) -> DataFrame:
    """Cluster every bucket by itself, then let the results of earlier buckets
    take in the locations that stayed alone in later ones."""
    within = greedy_cluster(
        with_bucket(points, n_buckets), radius, max_group_rows, ["road_key", "bucket_id"], rows
    )
    first = cut_lineage(within)
    return _suppress_later(first, radius, compat_counts, max_group_rows)


def _moves(first: DataFrame, radius: float, max_group_rows: int) -> DataFrame:
    """road_key, at, to of the lone locations that do not stand. The rule reads
    locations in order, like the clustering itself: bounded groups in one pass,
    larger ones by ground islands and by blocks. Only where so many buckets meet
    on little ground that no block fits do the open ones go round by round."""
    keys = ["road_key"]
    carry = ["bucket_id", "lone"]
    first = first.select(*keys, *AT, "bearing", *carry)
    total = first.count()
    if total <= max_group_rows:
        return _moved(_suppressed(first, keys, radius, total))
    placed = cut_lineage(assign_ground_islands(first, radius, keys))
    by = [*keys, "part_id"]
    sizes = placed.groupBy(*by).agg(F.count(F.lit(1)).alias("part_rows"))
    placed = cut_lineage(placed.join(sizes, by))
    small = F.col("part_rows") <= F.lit(max_group_rows)
    out = _moved(_suppressed(placed.filter(small), by, radius, total))
    rest = placed.filter(~small).select(first.columns)
    if rest.isEmpty():
        return out
    held = blocks.members(rest, radius, keys, max_group_rows, carry)
    if held is None:
        return out.unionByName(_moves_by_rounds(rest, radius))

    def decide(pdf, by):
        return in_order.suppress_groups(pdf, by, radius, pdf["given"].to_numpy())

    return out.unionByName(_moved(blocks.settle(held, keys, _in_batches, decide, ["bucket_id", *AT])))


def _moved(placed: DataFrame) -> DataFrame:
    gone = placed.filter(F.col("role") != in_order.STANDS)
    to = F.struct(*[F.col(t).alias(c) for t, c in zip(TO, AT)])
    return gone.select("road_key", F.struct(*AT).alias("at"), to.alias("to"))


def _suppressed(rows: DataFrame, by: list[str], radius: float, n: int) -> DataFrame:
    kinds = dict(rows.dtypes)
    schema = f"road_key string, seq {kinds['seq']}, lat double, lon double, role int, to {kinds['seq']}, to_lat double, to_lon double"

    def roles(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([*by, "bucket_id", *AT], ignore_index=True)
        target, _, role = in_order.suppress_groups(pdf, by, radius)
        goal = {t: pdf[c].to_numpy()[target] for t, c in zip(TO, AT)}
        return pdf.assign(**goal, role=role)[["road_key", *AT, "role", *TO]]

    return _in_batches(rows, by, n).applyInPandas(roles, schema)


def _moves_by_rounds(first: DataFrame, radius: float) -> DataFrame:
    """The same from all pairs in reach. Lone locations of one bucket never lie
    within the radius of one another, so the edges stay few per row; the rounds
    follow the longest chain of open ones."""
    keys = ["road_key"]
    cells = [*keys, "cell_y", "cell_x"]
    first = first.withColumn("at", F.struct(*AT))
    lone = first.filter("lone").select("road_key", F.col("at").alias("seq"), "bucket_id", "lat", "lon", "bearing")
    every = first.select("road_key", F.col("at").alias("seq"), "bucket_id", "lat", "lon", "bearing", "lone")
    side = _reach(every, radius, first.count())
    edges = cut_lineage(
        with_cell(lone, radius)
        .alias("p")
        .join(
            side.alias("s"),
            F.expr(
                f"{_same('p', 's', cells)} and s.bucket_id < p.bucket_id"
                f" and {_near('p', 's', radius)}"
            ),
        )
        .select(
            F.col("p.road_key").alias("road_key"),
            F.col("p.seq").alias("seq"),
            F.col("s.bucket_id").alias("to_bucket"),
            F.col("s.seq").alias("to"),
            F.col("s.lone").alias("to_lone"),
        )
    )
    # `gone`: lone locations known to be taken in; `stays`: known to stand.
    taken = edges.filter("not to_lone").select("road_key", "seq").distinct()
    undecided = cut_lineage(
        edges.select("road_key", "seq").distinct().join(taken, ["road_key", "seq"], "left_anti")
    )
    gone = taken
    while not undecided.isEmpty():
        blocking = undecided.select("road_key", F.col("seq").alias("to"), F.lit(1).alias("open"))
        lost = gone.select("road_key", F.col("seq").alias("to"), F.lit(1).alias("lost"))
        status = (
            edges.join(undecided, ["road_key", "seq"], "left_semi")
            .join(blocking, ["road_key", "to"], "left")
            .join(lost, ["road_key", "to"], "left")
            .groupBy("road_key", "seq")
            .agg(
                F.max(F.col("open").isNull() & F.col("lost").isNull()).alias("falls"),
                F.max(F.col("open").isNotNull()).alias("waits"),
            )
        )
        status = cut_lineage(status)
        gone = cut_lineage(gone.unionByName(status.filter("falls").select("road_key", "seq")))
        undecided = status.filter("waits and not falls").select("road_key", "seq")
    standing = edges.join(
        gone.select("road_key", F.col("seq").alias("to")), ["road_key", "to"], "left_anti"
    )
    return (
        standing.groupBy("road_key", "seq")
        .agg(F.min(F.struct("to_bucket", "to")).alias("_b"))
        .select("road_key", F.col("seq").alias("at"), F.col("_b.to").alias("to"))
    )


def _suppress_later(first: DataFrame, radius: float, compat_counts: bool, max_group_rows: int) -> DataFrame:
    """A lone location goes to the first (bucket, then seq) location of an
    earlier bucket that still stands."""
    first = first.withColumn("at", F.struct(F.col("hs_id").alias("seq"), "lat", "lon"))
    moves = _moves(first.withColumnRenamed("hs_id", "seq"), radius, max_group_rows)
    counted = F.when(F.col("to").isNotNull() & F.lit(compat_counts), F.lit(1)).otherwise(F.col("n"))
    sums = (
        first.join(moves, ["road_key", "at"], "left")
        .groupBy("road_key", F.coalesce("to", "at").alias("at"))
        .agg(
            F.sum(counted).cast("long").alias("n"),
            F.sum("n_added").cast("long").alias("n_added"),
        )
    )
    return (
        first.drop("n", "n_added", "bucket_id", "dist_sum", "lone")
        .join(sums, ["road_key", "at"])
        .select(*OUT[:8])
    )

"""Seeding: when no hot spots exist, a tenth of the interval founds them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PREFIX = 4  # hex digits: at most 65,536 counted prefixes per pass
FEW = 10_000  # rows that are ranked by themselves


def sample_key(incident_id: Column) -> Column:
    """Order of the sample: a hash of the id (none counts as empty text), then
    one of the place, so that rows which share an id do not go as one."""
    by_place = F.hex(F.xxhash64("road", "lat", "lon", "bearing"))
    by_id = F.md5(F.coalesce(incident_id.cast("string"), F.lit("")))
    return F.concat(by_id, F.lpad(by_place, 16, "0"))


def seed_threshold(incidents: DataFrame, percent: int) -> str | None:
    """Largest sample key inside the sample of floor(n * percent / 100) rows.

    Keys are counted by prefix, which folds on the map side to a bounded table,
    and again by a longer one below the prefix where the sample ends, until few
    rows share it; only those are ranked. Nothing is sorted or moved as a whole.
    None means an empty sample.
    """
    keyed = incidents.select(sample_key(F.col("incident_id")).alias("k"))
    wanted, prefix = None, ""
    below = keyed
    while True:
        length = len(prefix) + PREFIX
        counts = below.groupBy(F.substring("k", 1, length).alias("p")).agg(
            F.count(F.lit(1)).alias("c")
        )
        w = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        share = F.floor(F.sum("c").over(Window.partitionBy()) * F.lit(percent) / F.lit(100))
        goal = share if wanted is None else F.lit(wanted)
        edge = (
            counts.withColumns({"upto": F.sum("c").over(w), "wanted": goal})
            .filter("upto >= wanted and upto - c < wanted")
            .first()
        )
        if edge is None:
            return None
        prefix = edge["p"]
        wanted = edge["wanted"] - (edge["upto"] - edge["c"])
        below = keyed.filter(F.col("k").startswith(prefix))
        if len(prefix) < length:  # the whole key
            return prefix
        if edge["c"] <= FEW:
            break
    tail = below.groupBy("k").agg(F.count(F.lit(1)).alias("c"))
    w = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = tail.withColumn("upto", F.sum("c").over(w))
    return ranked.filter(F.col("upto") >= F.lit(wanted)).agg(F.min("k")).first()[0]


def seed_split(incidents: DataFrame, percent: int = 10) -> tuple[DataFrame, DataFrame]:
    """Sample and remainder, told apart by the sample key alone: no join, no
    index. Only rows that agree in id, road, place and bearing stay together."""
    last = seed_threshold(incidents, percent)
    if last is None:
        return incidents.limit(0), incidents
    inside = sample_key(F.col("incident_id")) <= F.lit(last)
    return incidents.filter(inside), incidents.filter(~inside)


def seed_sample(incidents: DataFrame, percent: int = 10) -> DataFrame:
    return seed_split(incidents, percent)[0]

"""Incidents, hot spots and a state derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LAT = "cast(50.0 + (user_id % 5) * 0.2 + ((event_id * 7919) % 1009) * 0.00005 as double)"
LON = "cast(-2.0 + (user_id % 4) * 0.1 + ((event_id * 104729) % 997) * 0.00002 as double)"
BEARING = "cast((event_id % 2) * 180 + (event_id * 17) % 50 as int)"
ROAD = "concat(case when event_id % 3 = 0 then 'm' else 'M' end, cast(user_id % 4 as string))"


def incidents(spark: SparkSession, sf_dir: str, days: int = 1) -> DataFrame:
    """Every event as an incident: four roads in mixed case, five places per
    road, two directions; an interval is `days` days."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.selectExpr(
        "event_id as incident_id",
        f"cast(floor((day(ts) - 1) / {days}) + 1 as int) as interval_id",
        f"{LAT} as lat",
        f"{LON} as lon",
        f"{BEARING} as bearing",
        f"{ROAD} as road",
        "ts",
    )


def hotspots(spark: SparkSession, sf_dir: str, per_degree: int = 5) -> DataFrame:
    """One hot spot per road, place and direction of all incidents: the one
    with the lowest id stands for the rest and carries their number. Places are
    bands of latitude, so that many to a degree crowd every cell."""
    by = (
        incidents(spark, sf_dir)
        .selectExpr("*", "lower(road) as _k", f"floor(lat * {per_degree}) as _p", "bearing >= 180 as _b")
        .groupBy("_k", "_p", "_b")
    )
    got = by.agg(
        F.count(F.lit(1)).cast("double").alias("fitness"),
        F.min(F.struct("incident_id", "lat", "lon", "road", "bearing")).alias("h"),
    )
    return got.selectExpr(
        "h.incident_id as hs_id",
        "lower(h.road) as road_key",
        "h.road",
        "h.lat",
        "h.lon",
        "h.bearing",
        "fitness",
        "1 as age",
        "cast(0.5 + (h.incident_id % 4) * 0.5 as double) as sd",
        "0 as created_interval",
        "0 as last_interval",
    )


def state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a hot spot of a state, with running sums."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.selectExpr(
        "event_id as hs_id",
        f"lower({ROAD}) as road_key",
        f"{ROAD} as road",
        f"{LAT} as lat",
        f"{LON} as lon",
        f"{BEARING} as bearing",
        "value as fitness",
        "cast(user_id % 9 as int) as age",
        "0 as created_interval",
        "0 as last_interval",
        "case when event_id % 7 = 0 then null else cast(15 + event_id % 261 as double) / 100 end"
        " as sd",
        "'NONE' as density_label",
        "cast(event_id % 13 as bigint) as n_added",
        "cast(event_id % 13 as double) * ((event_id * 31) % 250) / 100 as dist_sum",
    )

"""Interval metrics, output lines and heat map frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadpulse.functions.fuzzy import DENSE, SPARSE


def interval_metrics(
    outcome: DataFrame, by: list[str] | None = None, extra: list[Column] | None = None
) -> DataFrame:
    """Counts and ranges of one step (or of many, `by` interval) in a single
    aggregate over the step's outcome table, and what else the caller wants."""
    alive = F.col("status") != "deleted"
    shown = F.col("status") == "reported"
    cols = [
        F.count_if(F.col("is_new")).alias("n_new"),
        F.coalesce(F.sum("n_assigned"), F.lit(0)).cast("long").alias("n_assigned"),
        F.count_if(~alive).alias("n_deleted"),
        F.count_if(alive).alias("n_state"),
        F.count_if(shown).alias("n_reported"),
        F.min(F.when(alive, F.col("fitness"))).alias("fv_min"),
        F.max(F.when(alive, F.col("fitness"))).alias("fv_max"),
    ]
    if "sd" in outcome.columns:
        cols += [
            F.count_if(shown & (F.col("density_label") == DENSE)).alias("n_dense"),
            F.count_if(shown & (F.col("density_label") == SPARSE)).alias("n_sparse"),
            F.min(F.when(alive, F.col("sd"))).alias("sd_min"),
            F.max(F.when(alive, F.col("sd"))).alias("sd_max"),
        ]
    return outcome.groupBy(*(by or [])).agg(*cols, *(extra or []))


def density_labels(reported: DataFrame) -> DataFrame:
    return reported.groupBy("density_label").agg(F.count(F.lit(1)).alias("n_hotspots"))


def output_line(fuzzy: bool = False) -> Column:
    """Tab-joined place, fitness and age; in fuzzy mode also the spread, its
    label and the running count."""
    cols = ["lat", "lon", "fitness", "age"]
    if fuzzy:
        cols += ["sd", "density_label", "n_added"]
    return F.concat_ws("\t", *[F.col(c).cast("string") for c in cols])


def format_hotspots(reported: DataFrame, fuzzy: bool = False) -> DataFrame:
    return reported.select(output_line(fuzzy).alias("line"))


def format_metrics(metrics: DataFrame) -> DataFrame:
    """Metrics as name and two-decimal text, one line each."""
    names = [c for c, t in metrics.dtypes if t in ("double", "bigint", "int")]
    pairs = F.array(
        *[
            F.struct(
                F.lit(c).alias("metric"),
                F.format_string("%.2f" if t == "double" else "%d", F.col(c)).alias("text"),
            )
            for c, t in metrics.dtypes
            if c in names
        ]
    )
    return metrics.select(F.explode(pairs).alias("m")).select("m.*")


def heatmap_frames(
    history: DataFrame,
    first_day: int = 1,
    last_day: int = 558,
    min_points: int = 30,
) -> DataFrame:
    """Points of every day that has more than `min_points` of them, as rows, so
    that a day of any size stays spread out. The day counts are at most one row
    per day of the range, which bounds what is broadcast."""
    points = history.select(
        "DayID",
        F.col("Latitude").cast("double").alias("Latitude"),
        F.col("Longitude").cast("double").alias("Longitude"),
    ).filter(F.col("DayID").between(first_day, last_day))
    days = points.groupBy("DayID").agg(F.count(F.lit(1)).alias("points"))
    full = days.filter(F.col("points") > min_points).select("DayID")
    side = F.broadcast(full) if last_day - first_day < 100_000 else full
    return points.join(side, "DayID", "left_semi")


def hotspot_history(reported: DataFrame) -> DataFrame:
    """Reported hot spots of all intervals with the column names a map reads."""
    return reported.select(
        F.col("interval_id").cast("int").alias("DayID"),
        F.col("road").alias("Road"),
        F.col("bearing").alias("Bearing"),
        F.col("lat").alias("Latitude"),
        F.col("lon").alias("Longitude"),
        F.col("fitness").alias("Fitness"),
        F.col("age").alias("Age"),
    )

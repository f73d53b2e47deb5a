"""Stage 3: weigh updates, decay the state, merge, prune, report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadpulse.functions.fuzzy import idle_spread, update_sd

KEY = ["road_key", "lat", "lon"]
PAYLOAD = ["hs_id", "road", "bearing", "created_interval"]


def weight_updates(updates: DataFrame, weight: float, count: str = "n") -> DataFrame:
    """Fitness gained per update; an update is one interval older than the age
    it carries, and a new hot spot starts from zero."""
    age = F.col("age") if "age" in updates.columns else F.lit(0)
    return updates.withColumns(
        {
            "fitness": F.col(count).cast("double") * F.lit(weight),
            "age": (age + 1).cast("int"),
        }
    )


def decay_hotspots(state: DataFrame, decay_rate: float, steps: int = 1) -> DataFrame:
    """Fitness and age after `steps` intervals, before anything is added."""
    if steps == 1:
        factor = F.lit(1.0 - decay_rate)
    else:
        factor = F.pow(F.lit(1.0 - decay_rate), F.lit(float(steps)))
    return state.withColumns(
        {"fitness": F.col("fitness") * factor, "age": (F.col("age") + steps).cast("int")}
    )


def decay_spread(state: DataFrame, decay_rate: float, steps: int = 1) -> DataFrame:
    """Spread and label after `steps` intervals without incidents."""
    return idle_spread(state, decay_rate, steps)


def advance_idle(
    state: DataFrame, steps: int, decay_rate: float, delete_threshold: float, fuzzy: bool
) -> DataFrame:
    """The state after `steps` whole intervals in which nothing came. Decay only
    lowers fitness, so pruning once at the end equals pruning every time."""
    if steps <= 0:
        return state
    out = decay_hotspots(state, decay_rate, steps)
    if fuzzy:
        out = decay_spread(out, decay_rate, steps)
    return prune_hotspots(out, delete_threshold)


def all_updates(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Updates of known hot spots and of new ones in one bag."""
    return existing.unionByName(new, allowMissingColumns=True)


def _owner() -> Column:
    """Details of the oldest row at a place: the state before newcomers, then
    the lowest id. Updates have none of their own."""
    row = F.struct("is_new", *PAYLOAD)
    return F.min(F.when(F.col("hs_id").isNotNull(), row)).alias("_o")


def merge_state(rows: DataFrame, fuzzy: bool = False) -> DataFrame:
    """One row per place on a road: fitness and running sums add up, the oldest
    row lends its details. `rows` holds the decayed state, weighted updates of it
    (place and sums only) and new hot spots (`is_new`)."""
    sums = [
        F.sum("fitness").alias("fitness"),
        F.max("age").alias("age"),
        F.sum("n_assigned").cast("long").alias("n_assigned"),
        F.min("is_new").alias("is_new"),
    ]
    if fuzzy:
        sums += [
            F.sum("n_added").cast("long").alias("n_added"),
            F.sum("dist_sum").alias("dist_sum"),
            F.max("sd").alias("sd"),
        ]
    merged = rows.groupBy(*KEY).agg(*sums, _owner())
    return merged.select(
        *KEY,
        *[F.col(f"_o.{c}").alias(c) for c in PAYLOAD],
        *[c for c in merged.columns if c not in (*KEY, "_o")],
    )


def update_spread(merged: DataFrame, decay_rate: float, rule_base: str) -> DataFrame:
    """New spread and label from the interval's sums, which start over."""
    return update_sd(merged, decay_rate, rule_base).withColumns(
        {"n_added": F.lit(0).cast("long"), "dist_sum": F.lit(0.0)}
    )


def prune_hotspots(state: DataFrame, delete_threshold: float) -> DataFrame:
    return state.filter(F.col("fitness") >= F.lit(delete_threshold))


def report_hotspots(state: DataFrame, hotspot_threshold: float) -> DataFrame:
    return state.filter(F.col("fitness") >= F.lit(hotspot_threshold))


def status(delete_threshold: float, hotspot_threshold: float) -> Column:
    """deleted, kept (in the state) or reported (in the state and put out). A
    row must reach the delete threshold to be put out."""
    return (
        F.when(F.col("fitness") < F.lit(delete_threshold), F.lit("deleted"))
        .when(F.col("fitness") >= F.lit(hotspot_threshold), F.lit("reported"))
        .otherwise(F.lit("kept"))
    )

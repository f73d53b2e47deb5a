"""One interval as a function of the state and the interval's incidents."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadpulse.operators import assign, state as st
from roadpulse.operators.cluster import greedy_cluster, greedy_cluster_bucketed
from roadpulse.operators.seed import seed_split
from roadpulse.params import CrispParams, FuzzyParams
from roadpulse.session import cut_lineage
from roadpulse.sources.incidents import keyed_incidents, with_seq

NEEDED = ["incident_id", "road", "road_key", "lat", "lon", "bearing", "seq"]


@dataclass
class StepResult:
    """`outcome` holds every hot spot the step touched with its `status`;
    `max_rows` bounds its row count."""

    outcome: DataFrame
    n_incidents: int
    max_rows: int
    timings: dict[str, float] = field(default_factory=dict)
    held: list[DataFrame] = field(default_factory=list)

    def release(self) -> None:
        for df in self.held:
            df.unpersist()
        self.held = []


def state_of(outcome: DataFrame) -> DataFrame:
    return outcome.filter(F.col("status") != "deleted")


def reported_of(outcome: DataFrame) -> DataFrame:
    return outcome.filter(F.col("status") == "reported")


def interval_step(
    batch: DataFrame,
    state: DataFrame,
    params: CrispParams,
    interval_id: int,
    n_state: int | None = None,
) -> StepResult:
    """Match, cluster, merge, prune. `state` is the state after the interval
    before this one. `n_state` is its row count, where known: it decides whether
    the state may be broadcast and whether to seed."""
    fuzzy = isinstance(params, FuzzyParams)
    if n_state is None:
        n_state = state.count()
    held: list[DataFrame] = []
    timings: dict[str, float] = {}
    started = time.monotonic()

    def keep(df: DataFrame) -> DataFrame:
        held.append(df.persist())
        return df

    incidents = with_seq(keyed_incidents(batch)).select(*NEEDED)
    seeds = None
    n_seeds = 0
    if n_state == 0 and params.seed_when_empty and params.seed_percent > 0:
        incidents = keep(incidents)
        chosen, incidents = seed_split(incidents, params.seed_percent)
        locations = keep(assign.new_locations(chosen))
        seeds = cut_lineage(_cluster(locations, params, None))
        n_seeds = seeds.count()
        known = seeds.withColumn("sd", F.lit(None).cast("double"))
        rows = n_seeds
    else:
        known, rows = state, n_state

    ship = {"rows": rows, "limit": params.broadcast_rows}
    if rows > params.broadcast_rows:
        # The incidents must move to meet the hot spots: fold copies first.
        incidents = assign.positions(incidents)
    if fuzzy:
        n_rest = incidents.agg(F.sum("n") if "n" in incidents.columns else F.count("*")).first()[0]
        matched = assign.match_fuzzy(
            incidents, known, params.radius_miles, params.conf_threshold, **ship
        )
    else:
        matched = assign.assign_crisp(
            incidents,
            known,
            params.radius_miles,
            params.pick,
            **ship,
        )
    counted = keep(assign.tally(matched, fuzzy))
    found = counted.agg(F.sum("n").alias("n"), F.count_if("is_new").alias("open")).first()
    open_places = found["open"]
    n_rest = (n_rest if fuzzy else found["n"]) or 0
    updates, unmatched = counted.filter("not is_new"), counted.filter("is_new")
    timings["match_seconds"] = time.monotonic() - started

    started = time.monotonic()
    locations = assign.new_locations(unmatched)
    if open_places > params.max_group_rows or params.cluster_mode == "bucketed":
        locations = keep(locations)
    fresh = _cluster(locations, params, open_places)
    timings["cluster_seconds"] = time.monotonic() - started

    rows_in = st.all_updates(
        _updates(updates, params, fuzzy),
        _newcomers(fresh, params, fuzzy, interval_id, is_new=True),
    )
    if seeds is not None:
        rows_in = rows_in.unionByName(
            _newcomers(seeds, params, fuzzy, interval_id, is_new=False), allowMissingColumns=True
        )
    aged = st.decay_hotspots(state, params.decay_rate).drop("last_interval", "density_label")
    aged = aged.withColumns({"is_new": F.lit(False), "n_assigned": F.lit(0).cast("long")})
    merged = st.merge_state(rows_in.unionByName(aged, allowMissingColumns=True), fuzzy)
    if fuzzy:
        merged = st.update_spread(merged, params.decay_rate, params.rule_base)
    outcome = merged.withColumns(
        {
            "last_interval": F.lit(interval_id).cast("int"),
            "status": st.status(params.delete_threshold, params.hotspot_threshold),
        }
    )
    if seeds is not None:
        n_seeded = seeds.agg(F.sum("n")).first()[0] or 0
        n_rest += n_seeded
    return StepResult(outcome, n_rest, n_state + n_seeds + open_places, timings, held)


def _cluster(locations: DataFrame, params: CrispParams, rows: int | None) -> DataFrame:
    if params.cluster_mode == "bucketed":
        return greedy_cluster_bucketed(
            locations,
            params.cluster_miles,
            params.n_buckets,
            params.max_group_rows,
            params.compat_counts,
            rows,
        )
    return greedy_cluster(locations, params.cluster_miles, params.max_group_rows, rows=rows)


def _updates(updates: DataFrame, params: CrispParams, fuzzy: bool) -> DataFrame:
    out = st.weight_updates(updates, params.incident_weight, "fit" if fuzzy else "n")
    sums = [F.col("n").alias("n_added"), F.col("dist_sum")] if fuzzy else []
    return out.select(
        "road_key",
        "lat",
        "lon",
        "fitness",
        "age",
        F.col("n").alias("n_assigned"),
        "is_new",
        *sums,
    )


def _newcomers(
    centres: DataFrame, params: CrispParams, fuzzy: bool, interval_id: int, is_new: bool
) -> DataFrame:
    out = st.weight_updates(centres, params.incident_weight)
    sums = ["n_added", "dist_sum"] if fuzzy else []
    return out.select(
        "road_key",
        "lat",
        "lon",
        "fitness",
        "age",
        "hs_id",
        "road",
        "bearing",
        F.lit(interval_id).cast("int").alias("created_interval"),
        F.lit(0).cast("long").alias("n_assigned"),
        F.lit(is_new).alias("is_new"),
        *sums,
    )

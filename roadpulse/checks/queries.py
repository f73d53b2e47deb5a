"""One query per operator, each over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadpulse.checks import inputs
from roadpulse.functions import fuzzy, geo
from roadpulse.operators import assign, cluster, ground, islands, ranks, report, seed
from roadpulse.operators import state as st
from roadpulse.params import CrispParams, FuzzyParams
from roadpulse.plans.replay import replay
from roadpulse.plans.step import interval_step, state_of
from roadpulse.session import cut_lineage, scratch_path
from roadpulse.sources import history, incidents as src
from roadpulse.streaming import run, sinks

CLUSTER_MILES = 0.5
BUCKETS = 4
CRISP = CrispParams()
FUZZY = FuzzyParams()
STEP_CRISP = CrispParams(radius_miles=0.8)
STEP_FUZZY = FuzzyParams(radius_miles=2.0, init_miles=0.5)
REPLAY_CRISP = CrispParams(radius_miles=0.5)
REPLAY_FUZZY = FuzzyParams(radius_miles=1.5, init_miles=0.5)
REPLAY_DAYS = 5
MANY = 200  # bands to a degree, where hot spots are many
IDLE, LATER = 2, 5  # an interval without incidents, and the first one far on
FAR = 40


def tidy(df: DataFrame) -> DataFrame:
    """Doubles to six places, as in the SQL."""
    return df.select(
        *[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    )


def keyed(spark: SparkSession, sf: str) -> DataFrame:
    return src.with_seq(src.keyed_incidents(inputs.incidents(spark, sf)))


def locations(spark: SparkSession, sf: str) -> DataFrame:
    return cut_lineage(assign.new_locations(keyed(spark, sf)))


# --- sources ------------------------------------------------------------------


def incident_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Events as raw lines; some lack fields and some have a bearing that is no
    number."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    turn = f"case when event_id % 97 = 0 then 'north' else cast({inputs.BEARING} as string) end"
    head = (
        f"concat_ws(',', cast(event_id as string), cast({inputs.LAT} as string), "
        f"cast({inputs.LON} as string), {turn}"
    )
    full = (
        f"{head}, event_type, {inputs.ROAD}, 'unknown', cast(cast(ts as date) as string), "
        "date_format(ts, 'HH:mm:ss'), 'day')"
    )
    return e.selectExpr(
        f"case when event_id % 89 = 0 then {head}) else {full} end as value",
        "day(ts) as interval_id",
    )


def parse_incident_lines(spark, sf):
    parsed = src.parse_incident_lines(incident_lines(spark, sf).drop("interval_id"))
    return tidy(parsed.select("incident_id", "lat", "lon", "bearing", "road", "date", "bad_reason"))


def read_incident_csv(spark, sf):
    path = scratch_path(spark, "csv")
    incident_lines(spark, sf).write.partitionBy("interval_id").text(path)
    parsed = src.read_incident_csv(spark, path)
    good = src.good_rows(parsed).select(
        "interval_id", "incident_id", "lat", "lon", "bearing", "road"
    )
    bad = src.quarantine_rows(parsed).select(
        "interval_id", F.split("value", ",")[0].alias("incident_id"), "bad_reason"
    )
    return tidy(good.unionByName(bad, allowMissingColumns=True))


def keyed_incidents(spark, sf):
    got = keyed(spark, sf)
    return tidy(got.select("incident_id", "lat", "lon", "bearing", "road_key", "age"))


def assign_interval(spark, sf):
    got = src.assign_interval(
        inputs.incidents(spark, sf).drop("interval_id"), 4, "2024-01-01 00:00:00"
    )
    return got.select("incident_id", "interval_id")


def read_hotspot_history(spark, sf):
    path = scratch_path(spark, "history")
    sinks.write_history(
        report.hotspot_history(
            inputs.state(spark, sf).withColumn("interval_id", F.col("age") + 1)
        ),
        path,
    )
    got = history.read_hotspot_history(spark, path)
    return tidy(got.toDF(*[c.lower() for c in got.columns]))


# --- predicates and pairs -----------------------------------------------------


def _road_pairs(spark, sf):
    hs = inputs.hotspots(spark, sf)
    return assign.road_pairs(keyed(spark, sf), hs, CRISP.radius_miles)


def bearing_pairs(spark, sf):
    return _road_pairs(spark, sf).selectExpr(
        "incident_id",
        "hs_id",
        f"cast({geo.bearing_delta('bearing', 'hs_bearing')} as int) as delta",
        f"{geo.bearing_compatible('bearing', 'hs_bearing')} as compatible",
    )


def haversine_pairs(spark, sf):
    return tidy(_road_pairs(spark, sf).select("incident_id", "hs_id", "miles"))


def gated_pairs(spark, sf):
    a = {"road_key": "road_key", "bearing": "bearing", "lat": "lat", "lon": "lon"}
    b = {"road_key": "road_key", "bearing": "hs_bearing", "lat": "hs_lat", "lon": "hs_lon"}
    return tidy(
        _road_pairs(spark, sf).selectExpr(
            "incident_id", "hs_id", f"{geo.gated_miles(a, b)} as miles"
        )
    )


def candidate_pairs(spark, sf):
    hs = inputs.hotspots(spark, sf)
    got = assign.candidate_pairs(keyed(spark, sf), hs, CRISP.radius_miles)
    return tidy(got.select("incident_id", "hs_id", "miles"))


# --- stage 1 ------------------------------------------------------------------


def _assigned(spark, sf, pick="nearest", radius=STEP_CRISP.radius_miles):
    hs = cut_lineage(inputs.hotspots(spark, sf))
    return assign.assign_crisp(keyed(spark, sf), hs, radius, pick, rows=hs.count())


def assign_nearest_join(spark, sf):
    """The way for more hot spots than may be broadcast."""
    got = assign.assign_crisp(
        keyed(spark, sf), inputs.hotspots(spark, sf), STEP_CRISP.radius_miles, rows=None
    )
    return tidy(got.select("incident_id", "hs_id", "miles"))


def assign_nearest_many(spark, sf):
    """Several candidates in every cell."""
    got = assign.assign_crisp(
        keyed(spark, sf), inputs.hotspots(spark, sf, MANY), STEP_CRISP.radius_miles, rows=None
    )
    return tidy(got.select("incident_id", "hs_id", "miles"))


def assign_nearest(spark, sf):
    return tidy(_assigned(spark, sf).select("incident_id", "hs_id", "miles"))


def assign_first(spark, sf):
    got = _assigned(spark, sf, "first", CRISP.radius_miles)
    return tidy(got.select("incident_id", "hs_id", "miles"))


def unassigned_incidents(spark, sf):
    got = assign.unassigned_incidents(
        keyed(spark, sf), inputs.hotspots(spark, sf), STEP_CRISP.radius_miles
    )
    return got.select("incident_id", "road_key")


def split_assigned(spark, sf):
    taken, left = assign.split_assigned(_assigned(spark, sf))
    return taken.select("incident_id", F.lit("taken").alias("part")).unionByName(
        left.select("incident_id", F.lit("left").alias("part"))
    )


def count_updates(spark, sf):
    return assign.count_updates(_assigned(spark, sf))


def new_locations(spark, sf):
    _, left = assign.split_assigned(_assigned(spark, sf))
    return tidy(assign.new_locations(left))


def fuzzy_membership(spark, sf):
    m = fuzzy.membership("miles", "hs_sd", FUZZY.radius_miles)
    hs = inputs.hotspots(spark, sf)
    pairs = assign.candidate_pairs(keyed(spark, sf), hs, FUZZY.radius_miles)
    return tidy(pairs.selectExpr("incident_id", "hs_id", f"{m} as membership"))


def _fuzzy_pairs(spark, sf):
    return assign.assign_fuzzy(
        keyed(spark, sf), inputs.hotspots(spark, sf), FUZZY.radius_miles, FUZZY.conf_threshold
    )


def assign_fuzzy(spark, sf):
    return tidy(_fuzzy_pairs(spark, sf).select("incident_id", "hs_id", "membership", "miles"))


def assign_fuzzy_many(spark, sf):
    got = assign.assign_fuzzy(
        keyed(spark, sf), inputs.hotspots(spark, sf, MANY), FUZZY.radius_miles, FUZZY.conf_threshold
    )
    return tidy(got.select("incident_id", "hs_id", "membership", "miles"))


def unassigned_fuzzy(spark, sf):
    got = assign.unassigned_fuzzy(
        keyed(spark, sf), inputs.hotspots(spark, sf), FUZZY.radius_miles, FUZZY.conf_threshold
    )
    return got.select("incident_id", "road_key")


def count_updates_fuzzy(spark, sf):
    return tidy(assign.count_updates_fuzzy(_fuzzy_pairs(spark, sf)))


# --- stage 2 ------------------------------------------------------------------


def seed_sample(spark, sf):
    return seed.seed_split(keyed(spark, sf))[0].select("incident_id", "road_key")


def seed_remainder(spark, sf):
    return seed.seed_split(keyed(spark, sf))[1].select("incident_id", "road_key")


def first_neighbour(spark, sf):
    pts = locations(spark, sf)
    got = cluster.first_later_neighbour(pts, pts, CLUSTER_MILES, ["road_key"])
    return tidy(
        got.select(
            "seq", F.col("next.seq").alias("next_seq"), F.col("next.miles").alias("miles")
        )
    )


def islands_query(spark, sf):
    got = islands.assign_islands(locations(spark, sf), CLUSTER_MILES)
    return got.select("seq", "road_key", "island_id")


def ground_islands(spark, sf):
    """Islands by the ground covered, named after their first location."""
    placed = ground.assign_ground_islands(locations(spark, sf), CLUSTER_MILES, ["road_key"])
    placed = cut_lineage(placed)
    named = placed.groupBy("road_key", "part_id").agg(F.min("seq").alias("island"))
    return placed.join(named, ["road_key", "part_id"]).select("seq", "road_key", "island")


def greedy_cluster(spark, sf):
    got = cluster.greedy_cluster(locations(spark, sf), CLUSTER_MILES)
    return tidy(got.select("hs_id", "road_key", "lat", "lon", "bearing", "n"))


def greedy_cluster_sums(spark, sf):
    got = cluster.greedy_cluster(locations(spark, sf), CLUSTER_MILES, max_group_rows=2_000)
    return tidy(got.select("hs_id", "n", "n_added", "dist_sum"))


def greedy_cluster_rounds(spark, sf):
    got = cluster.cluster_in_rounds(locations(spark, sf), CLUSTER_MILES, max_group_rows=2_000)
    return tidy(got.select("hs_id", "n", "n_added", "dist_sum"))


def greedy_cluster_bucketed(spark, sf):
    got = cluster.greedy_cluster_bucketed(locations(spark, sf), CLUSTER_MILES, BUCKETS)
    return tidy(got.select("hs_id", "road_key", "lat", "lon", "n"))


# --- stage 3 ------------------------------------------------------------------


def _new(spark, sf):
    _, left = assign.split_assigned(_assigned(spark, sf))
    return assign.new_locations(left).withColumnRenamed("seq", "hs_id")


def all_updates(spark, sf):
    old = assign.count_updates(_assigned(spark, sf))
    got = st.all_updates(old, _new(spark, sf).select("hs_id", "road_key", "n"))
    return got.select("hs_id", "road_key", "n")


def weight_updates(spark, sf):
    got = st.weight_updates(assign.count_updates(_assigned(spark, sf)), 1.5)
    return tidy(got.select("hs_id", "fitness", "age"))


def decay_hotspots(spark, sf):
    got = st.decay_hotspots(inputs.state(spark, sf), CRISP.decay_rate)
    return tidy(got.select("hs_id", "fitness", "age"))


def decay_gap(spark, sf):
    got = st.decay_hotspots(inputs.state(spark, sf), CRISP.decay_rate, 3)
    got = st.decay_spread(got, CRISP.decay_rate, 3)
    return tidy(got.select("hs_id", "fitness", "age", "sd", "density_label"))


def merge_state(spark, sf):
    state = st.decay_hotspots(inputs.state(spark, sf), CRISP.decay_rate)
    new = st.weight_updates(assign.new_locations(keyed(spark, sf)), 1.0)
    rows = state.selectExpr("*", "false as is_new", "0L as n_assigned").unionByName(
        new.selectExpr(
            "seq as hs_id", "road_key", "road", "lat", "lon", "bearing", "fitness", "age",
            "1 as created_interval", "true as is_new", "n as n_assigned",
        ),
        allowMissingColumns=True,
    )
    got = st.merge_state(rows)
    return tidy(got.select("hs_id", "road_key", "lat", "lon", "fitness", "age"))


def merge_state_fuzzy(spark, sf):
    state = st.decay_hotspots(inputs.state(spark, sf), FUZZY.decay_rate)
    new = assign.new_locations(keyed(spark, sf)).selectExpr(
        "seq as hs_id", "road_key", "road", "lat", "lon", "bearing", "cast(n as double) as fitness",
        "1 as age", "1 as created_interval", "true as is_new", "n as n_assigned",
        "n as n_added", "n * 0.25D as dist_sum",
    )
    rows = state.selectExpr("*", "false as is_new", "0L as n_assigned")
    got = st.merge_state(rows.unionByName(new, allowMissingColumns=True), fuzzy=True)
    return tidy(got.select("hs_id", "fitness", "age", "n_added", "dist_sum", "sd"))


def prune_hotspots(spark, sf):
    got = st.prune_hotspots(inputs.state(spark, sf), CRISP.delete_threshold)
    return tidy(got.select("hs_id", "fitness"))


def report_hotspots(spark, sf):
    got = st.report_hotspots(inputs.state(spark, sf), CRISP.hotspot_threshold)
    return tidy(got.select("hs_id", "fitness"))


# --- fuzzy update -------------------------------------------------------------


def fuzzy_density(spark, sf):
    s = inputs.state(spark, sf)
    s = s.selectExpr("hs_id", "n_added", "case when n_added > 0 then dist_sum / n_added end as mean_miles")
    tight = fuzzy.with_density(s, "n_added", "mean_miles").withColumnRenamed("density", "tight")
    both = fuzzy.with_density(tight, "n_added", "mean_miles", "initial")
    return both.selectExpr("hs_id", "round(tight, 9) as tight", "round(density, 9) as initial")


def update_sd(spark, sf):
    got = st.update_spread(inputs.state(spark, sf), FUZZY.decay_rate, FUZZY.rule_base)
    return tidy(got.select("hs_id", "sd", "density_label", "n_added", "dist_sum"))


def density_labels(spark, sf):
    got = st.update_spread(inputs.state(spark, sf), FUZZY.decay_rate, FUZZY.rule_base)
    return report.density_labels(st.report_hotspots(got, FUZZY.hotspot_threshold))


# --- reports ------------------------------------------------------------------


def _outcome(spark, sf):
    s = st.update_spread(inputs.state(spark, sf), FUZZY.decay_rate, FUZZY.rule_base)
    return s.withColumns(
        {
            "status": st.status(20.0, 40.0),
            "is_new": F.col("age") == 1,
            "n_assigned": F.col("hs_id") % 5,
            "interval_id": F.col("age"),
        }
    )


def interval_metrics(spark, sf):
    return tidy(report.interval_metrics(_outcome(spark, sf), by=["interval_id"]))


def format_metrics(spark, sf):
    return report.format_metrics(report.interval_metrics(_outcome(spark, sf)))


def rank_quantiles_fitness(spark, sf):
    return tidy(ranks.rank_quantiles(inputs.state(spark, sf), "fitness"))


def rank_quantiles_sd(spark, sf):
    return tidy(ranks.rank_quantiles(inputs.state(spark, sf), "sd"))


def format_hotspots(spark, sf):
    return report.format_hotspots(st.report_hotspots(inputs.state(spark, sf), 5.0))


def format_hotspots_fuzzy(spark, sf):
    s = st.update_spread(inputs.state(spark, sf), FUZZY.decay_rate, FUZZY.rule_base)
    return report.format_hotspots(st.report_hotspots(s, 5.0), fuzzy=True)


def write_hotspots(spark, sf):
    """Text lines per interval, written and read back."""
    path = scratch_path(spark, "hotspots")
    shown = st.report_hotspots(inputs.state(spark, sf), 5.0)
    sinks.write_hotspots(shown.withColumn("interval_id", F.col("age") + 1), path, "tsv")
    return spark.read.schema("value string, interval_id int").text(path)


def write_latest(spark, sf):
    """Two intervals written to one folder, which then holds the second."""
    path = scratch_path(spark, "latest")
    for threshold in (40.0, 5.0):
        sinks.write_latest(st.report_hotspots(inputs.state(spark, sf), threshold), path)
    return spark.read.text(path)


def heatmap_frames(spark, sf):
    points = inputs.state(spark, sf).withColumn(
        "interval_id", F.pmod(F.col("hs_id") * 7 + F.col("age") * 3, F.lit(200))
    )
    limit = 50
    got = report.heatmap_frames(report.hotspot_history(points), 1, 150, limit)
    return tidy(got.toDF("day_id", "latitude", "longitude"))


# --- steps, replays, streams --------------------------------------------------

SHOWN = [
    "hs_id", "road_key", "lat", "lon", "bearing", "fitness", "age", "n_assigned", "is_new", "status",
]


def _step(spark, sf, params):
    state = inputs.hotspots(spark, sf)
    if isinstance(params, FuzzyParams):
        state = state.selectExpr(
            "*", "'NONE' as density_label", "0L as n_added", "0D as dist_sum"
        )
    else:
        state = state.drop("sd")
    got = interval_step(inputs.incidents(spark, sf), cut_lineage(state), params, 1)
    more = ["sd", "density_label"] if isinstance(params, FuzzyParams) else []
    return tidy(got.outcome.select(*SHOWN, *more))


def step_crisp(spark, sf):
    return _step(spark, sf, STEP_CRISP)


def step_fuzzy(spark, sf):
    return _step(spark, sf, STEP_FUZZY)


def step_bucketed(spark, sf):
    return _step(
        spark,
        sf,
        CrispParams(
            radius_miles=STEP_CRISP.radius_miles, cluster_mode="bucketed", n_buckets=BUCKETS
        ),
    )


def _last_state(store):
    got = store.outcomes()
    last = store.latest().interval_id
    return state_of(got.filter(F.col("interval_id") == last))


def _replay(spark, sf, params):
    rows = inputs.incidents(spark, sf, REPLAY_DAYS)
    return replay(rows, scratch_path(spark, "replay"), params)


def replay_crisp(spark, sf):
    """The state after the last interval."""
    got = _last_state(_replay(spark, sf, REPLAY_CRISP))
    return tidy(got.select("hs_id", "road_key", "lat", "lon", "fitness", "age"))


def replay_fuzzy(spark, sf):
    got = _last_state(_replay(spark, sf, REPLAY_FUZZY))
    return tidy(got.select("hs_id", "road_key", "fitness", "age", "sd", "density_label"))


FIGURES = [
    "interval_id", "n_incidents", "n_assigned", "n_new", "n_deleted", "n_state", "n_reported",
]


def replay_metrics(spark, sf):
    return _replay(spark, sf, REPLAY_CRISP).metrics().select(*FIGURES)


def _replay_gaps(spark, sf):
    """An idle interval, then so many that the state empties and is seeded again."""
    t = F.col("interval_id")
    rows = inputs.incidents(spark, sf, REPLAY_DAYS).filter(t != IDLE)
    rows = rows.withColumn("interval_id", F.when(t >= LATER, t + FAR).otherwise(t))
    return replay(rows, scratch_path(spark, "replay"), REPLAY_CRISP)


def replay_gaps(spark, sf):
    got = _last_state(_replay_gaps(spark, sf))
    return tidy(got.select("hs_id", "road_key", "lat", "lon", "fitness", "age"))


def replay_gaps_metrics(spark, sf):
    return _replay_gaps(spark, sf).metrics().select(*FIGURES)


def stream_replay(spark, sf):
    """Interval files, several per interval, read as a stream; ids are text."""
    files = scratch_path(spark, "feed")
    _feed_lines(spark, sf).write.partitionBy("interval_id").text(files)
    store = _stream(spark, files, scratch_path(spark, "stream"), scratch_path(spark, "offsets"))
    got = _last_state(store)
    return tidy(got.select("hs_id", "road_key", "lat", "lon", "fitness", "age"))


def _feed_lines(spark, sf):
    feed = incident_lines(spark, sf).withColumn(
        "interval_id", (F.floor((F.col("interval_id") - 1) / REPLAY_DAYS) + 1).cast("int")
    )
    return feed.repartition(3)


def _stream(spark, files, root, offsets):
    run.run_stream(src.stream_incident_csv(spark, files), root, offsets, REPLAY_CRISP)
    return run.RunStore(spark, root, T.LongType(), False)


def incident_accounting(spark, sf):
    """Where every line of a feed went, by interval: a fifth of the lines comes
    when its interval is closed, and some lines have no interval."""
    files, root, offsets = (scratch_path(spark, n) for n in ("feed", "stream", "offsets"))
    number = F.split("value", ",")[0].cast("long")
    feed = _feed_lines(spark, sf).withColumn(
        "interval_id", F.when(number % 83 != 0, F.col("interval_id"))
    )
    for late in (False, True):
        part = feed.filter((number % 5 == 0) == late)
        part.write.mode("append").partitionBy("interval_id").text(files)
        store = _stream(spark, files, root, offsets)
    counted = store.metrics().select("interval_id", F.lit("counted").alias("went"), F.col("n_incidents").alias("n"))
    for kind in ("late", "quarantine"):
        rows = store.read_aside(kind).groupBy("interval_id").agg(F.count(F.lit(1)).alias("n"))
        counted = counted.unionByName(rows.withColumn("went", F.lit(kind)))
    return counted


def stream_progress(spark, sf):
    """One row per batch of a stream, with whether its delay is known."""
    files = scratch_path(spark, "feed")
    _feed_lines(spark, sf).write.partitionBy("interval_id").text(files)
    store = _stream(spark, files, scratch_path(spark, "stream"), scratch_path(spark, "offsets"))
    return store.progress().select("batch_id", "n_rows")


QUERIES = {
    f.__name__: f
    for f in [
        parse_incident_lines, read_incident_csv, keyed_incidents, assign_interval,
        read_hotspot_history, bearing_pairs, haversine_pairs, gated_pairs, candidate_pairs,
        assign_nearest, assign_nearest_join, assign_nearest_many, assign_fuzzy_many, assign_first, unassigned_incidents, split_assigned, count_updates,
        new_locations, fuzzy_membership, assign_fuzzy, unassigned_fuzzy, count_updates_fuzzy,
        seed_sample, seed_remainder, first_neighbour, greedy_cluster, greedy_cluster_sums,
        ground_islands, greedy_cluster_rounds, greedy_cluster_bucketed, all_updates, weight_updates,
        decay_hotspots, decay_gap, merge_state, merge_state_fuzzy, prune_hotspots,
        report_hotspots, fuzzy_density, update_sd, density_labels, interval_metrics,
        rank_quantiles_fitness, rank_quantiles_sd, format_hotspots, format_hotspots_fuzzy,
        write_hotspots, heatmap_frames, step_crisp, step_fuzzy, step_bucketed, replay_crisp,
        replay_fuzzy, replay_metrics, replay_gaps, replay_gaps_metrics, stream_replay, incident_accounting,
        format_metrics, write_latest, stream_progress,
    ]
}
QUERIES["islands"] = islands_query

import pytest

from roadpulse.operators import cluster, islands
from roadpulse.operators.assign import new_locations
from tests import data, plain

SETS = {
    "mixed": (data.rows(300, 11), 1.5),
    "hot place": (data.rows(300, 12, hot=0.34), 1.0),
    "dense cell": (data.rows(300, 13, roads=("m1",), spread=0.02), 0.5),
    "sparse": (data.rows(120, 14, spread=2.0), 1.0),
    "one way": (data.rows(250, 15, roads=("M1",), spread=0.08, bearings=[5]), 1.0),
}


def locs(spark, items):
    return new_locations(data.keyed(spark, items)).persist()


def as_dict(df):
    return {r["hs_id"]: (r["n"], r["n_added"], round(r["dist_sum"], 6)) for r in df.collect()}


def wanted(items, r):
    got = plain.greedy(plain.locations(items), r)
    return {k: (v[0], v[1], round(v[2], 6)) for k, v in got.items()}


@pytest.mark.parametrize("name", SETS)
def test_grouped(spark, name):
    items, r = SETS[name]
    want = wanted(items, r)
    got = as_dict(cluster.greedy_cluster(locs(spark, items), r))
    assert got == want
    assert sum(v[0] for v in got.values()) == len(items)


@pytest.mark.parametrize("name", ["mixed", "dense cell", "one way"])
def test_rounds(spark, name):
    items, r = SETS[name]
    assert as_dict(cluster.cluster_in_rounds(locs(spark, items), r, 40)) == wanted(items, r)


def test_rounds_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(cluster, "BROADCAST_ROWS", 0)
    items, r = SETS["one way"]
    assert as_dict(cluster.cluster_in_rounds(locs(spark, items), r, 40)) == wanted(items, r)


def test_rounds_when_everything_comes_late(spark):
    """One cluster follows another in the order: nothing known covers a slice."""
    items = data.rows(60, 21, spread=0.03) + [
        dict(x, id=x["id"] + 1000) for x in data.rows(150, 22, spread=0.03, at=(53.0, 1.0))
    ]
    assert as_dict(cluster.cluster_in_rounds(locs(spark, items), 0.8, 30)) == wanted(items, 0.8)


def test_small_and_big_islands_together(spark):
    items = data.rows(150, 31, spread=0.04) + [
        dict(x, id=x["id"] + 1000) for x in data.rows(25, 32, spread=0.04, at=(55.0, 1.0))
    ]
    assert as_dict(cluster.greedy_cluster(locs(spark, items), 0.8, 60)) == wanted(items, 0.8)


def test_islands_never_split_neighbours(spark):
    items, r = SETS["sparse"]
    placed = islands.assign_islands(locs(spark, items), r).collect()
    at = {p["seq"]: (p["road_key"], p["island_id"]) for p in placed}
    pts = plain.locations(items)
    assert len(at) == len(pts) and len(set(at.values())) > 5
    for a in pts:
        for b in pts:
            if plain.within(a, b, r):
                assert at[a["id"]] == at[b["id"]]


@pytest.mark.parametrize("name", ["mixed", "dense cell", "one way"])
@pytest.mark.parametrize("compat", [False, True])
def test_bucketed(spark, name, compat):
    items, r = SETS[name]
    got = cluster.greedy_cluster_bucketed(locs(spark, items), r, 3, compat_counts=compat)
    assert {x["hs_id"]: x["n"] for x in got.collect()} == plain.bucketed(
        plain.locations(items), r, 3, compat
    )


def test_first_later_neighbour(spark):
    items, r = SETS["mixed"]
    pts = locs(spark, items)
    got = cluster.first_later_neighbour(pts, pts, r, ["road_key"])
    found = {x["seq"]: x["next"]["seq"] if x["next"] else None for x in got.collect()}
    rows = plain.locations(items)
    for i, a in enumerate(rows):
        later = [b["id"] for b in rows[i + 1 :] if plain.within(a, b, r)]
        assert found[a["id"]] == (later[0] if later else None)


def test_first_later_neighbour_looks_at_few_pairs(spark, monkeypatch):
    """Points on a small ground, in slices: the pairs handed on follow the points,
    not their square, and the next ones are those of all pairs."""
    monkeypatch.setattr(cluster, "SLICE_ROWS", 100)
    items = data.rows(900, 16, roads=("m1", "A5"), spread=0.02)
    pts = locs(spark, items)
    ahead = cluster._pairs_ahead(pts, pts, 0.8, ["road_key"])
    assert 0 < ahead.count() < 40 * len(items)
    got = cluster.first_later_neighbour(pts, pts, 0.8, ["road_key"])
    want = cluster.first_later_neighbour(pts, pts, 0.8, ["road_key"], len(items))
    rows = [{(x["seq"], x["road_key"], x["next"]) for x in df.collect()} for df in (got, want)]
    assert rows[0] == rows[1] and any(r[2] is None for r in rows[0])


def test_first_later_neighbour_of_other_points(spark):
    """Probes that are no points, rows with gaps, and places that share an id."""
    cols = "road_key string, seq long, lat double, lon double, bearing int"
    rows = [("m", i // 2 if i % 7 else None, 52.0 + i % 13 / 500, -1.0 + i % 5 / 300, None if i % 31 == 0 else i * 50 % 360) for i in range(200)]
    pts = spark.createDataFrame(rows[::2] + [(None, 5, 52.0, -1.0, 10), ("m", 7, None, -1.0, 10)], cols)
    probes = spark.createDataFrame(rows[1::2] + [("m", 3, float("nan"), -1.0, 10)], cols)
    got = cluster.first_later_neighbour(probes, pts, 0.7, ["road_key"])
    want = cluster.first_later_neighbour(probes, pts, 0.7, ["road_key"], 101)
    both = [sorted((tuple(r) for r in df.collect()), key=str) for df in (got, want)]
    assert str(both[0]) == str(both[1]) and sum(r[-1] is not None for r in both[0]) > 40


def test_first_later_neighbour_of_none(spark):
    pts = locs(spark, SETS["mixed"][0]).filter("false")
    assert cluster.first_later_neighbour(pts, pts, 1.0, ["road_key"]).count() == 0


def test_no_rows(spark):
    pts = locs(spark, SETS["mixed"][0]).filter("false")
    assert cluster.greedy_cluster(pts, 1.0).count() == 0
    assert cluster.cluster_in_rounds(pts, 1.0).count() == 0
    assert cluster.greedy_cluster_bucketed(pts, 1.0, 2).count() == 0


def test_text_ids_and_hashed_order(spark):
    from roadpulse.sources.incidents import with_seq

    items = data.rows(80, 41)
    df = data.keyed(spark, items)
    df = df.withColumn("incident_id", df.incident_id.cast("string"))
    pts = new_locations(with_seq(df, "hash"))
    got = cluster.greedy_cluster(pts, 1.5)
    assert got.agg({"n": "sum"}).first()[0] == len(items)
    assert as_dict(got) == as_dict(cluster.cluster_in_rounds(pts, 1.5, 20))


def by_place(df):
    return {(r["road_key"], r["lat"], r["lon"]): (r["n"], r["n_added"], round(r["dist_sum"], 6)) for r in df.collect()}


@pytest.mark.parametrize("null_every", [0, 9])
def test_repeated_and_missing_ids(spark, null_every):
    """Both ways see the same order, and no incident is counted twice."""
    from pyspark.sql import functions as F
    from roadpulse.sources.incidents import with_seq

    items = [dict(x, id=x["id"] // 3) for x in SETS["dense cell"][0]]
    df = data.keyed(spark, items).drop("seq")
    if null_every:
        df = df.withColumn("incident_id", F.when(F.col("incident_id") % null_every > 0, F.col("incident_id")))
    pts = new_locations(with_seq(df)).persist()
    got = by_place(cluster.greedy_cluster(pts, 0.5))
    assert sum(v[0] for v in got.values()) == len(items)
    assert got == by_place(cluster.cluster_in_rounds(pts, 0.5, 40))
    both = cluster.greedy_cluster_bucketed(pts, 0.5, 3)
    assert both.agg({"n": "sum"}).first()[0] == len(items)


def test_no_group_above_the_bound(spark, monkeypatch):
    """Waiting locations that bridge islands count towards the bound too."""
    items, r = SETS["one way"]
    largest = []
    settle = cluster._settle_slice

    def watched(grouped, radius, keys, rows):
        parts = [c for c in ("island_id", "part_id") if c in grouped.columns]
        by = [*keys, *parts]
        top = grouped.groupBy(*by).count().agg({"count": "max"}).first()[0]
        largest.append(top or 0)
        return settle(grouped, radius, keys, rows)

    monkeypatch.setattr(cluster, "_settle_slice", watched)
    sparse = data.rows(150, 44, roads=("m1",), spread=0.6, bearings=[5])
    for rows, miles in ((items[:90], r), (sparse[:80], 1.0)):
        assert as_dict(cluster.cluster_in_rounds(locs(spark, rows), miles, 30)) == wanted(rows, miles)
    assert max(largest) <= 30


TOWNS = {
    # A road along a parallel, a name that towns on one parallel share, both
    # sides of the date line, and a place close to a pole.
    "east-west": [
        dict(x, lat=52.0, lon=round(-1 + x["id"] * 0.012, 4))
        for x in data.rows(60, 51, roads=("m1",), bearings=[5])
    ],
    "one name, many towns": [
        dict(x, lon=x["lon"] + x["id"] % 12)
        for x in data.rows(90, 52, roads=("m1",), spread=0.03, bearings=[5])
    ],
    "date line": [
        dict(x, lon=(x["lon"] + 181 + 180) % 360 - 180 if x["id"] % 3 else 20 + x["lon"])
        for x in data.rows(70, 53, roads=("m1",), spread=0.06, bearings=[5], at=(10.0, -1.03))
    ],
    "near a pole": data.rows(60, 54, roads=("m1",), spread=0.2, bearings=[5], at=(89.7, 0.0)),
}


@pytest.mark.parametrize("name", TOWNS)
def test_islands_cut_by_longitude(spark, name):
    items = TOWNS[name]
    want = wanted(items, 1.0)
    pts = locs(spark, items)
    assert as_dict(cluster.greedy_cluster(pts, 1.0, 30)) == want
    # No two places of different parts are within the radius.
    placed = islands.assign_parts(pts, 1.0).collect()
    assert len(placed) == pts.count()
    for i, a in enumerate(placed):
        for b in placed[:i]:
            if (a["island_id"], a["part_id"]) != (b["island_id"], b["part_id"]):
                assert not plain.miles(a, b) <= 1.0


def test_a_shared_name_needs_no_rounds(spark, monkeypatch):
    monkeypatch.setattr(cluster, "cluster_in_rounds", None)
    items = TOWNS["one name, many towns"]
    assert as_dict(cluster.greedy_cluster(locs(spark, items), 1.0, 30)) == wanted(items, 1.0)

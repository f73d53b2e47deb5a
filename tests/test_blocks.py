"""Ground islands and block-wise clustering against plain passes."""

import math
import random

import pytest

from roadpulse.operators import blocks, cluster, ground
from tests import data, plain
from tests.test_cluster import as_dict, locs, wanted


def road(n, step, seed=1, ids="along", jitter=0.4, bend=0.0):
    """Places along one unbroken road, `step` miles apart on average."""
    r = random.Random(seed)
    lat, out = 51.0, []
    order = list(range(n))
    if ids == "random":
        r.shuffle(order)
    for i in range(n):
        lat += step / 69.0 * (1 + r.uniform(-jitter, jitter))
        lon = -1.0 + bend * math.sin(i / 40)
        out.append(data.rows(1, 1, roads=("m1",), bearings=[5])[0] | {"id": order[i], "lat": round(lat, 6), "lon": round(lon, 6)})
    return out


def settled(spark, items, radius, most):
    pts, log = locs(spark, items), []
    held = blocks.members(pts, radius, ["road_key"], most)
    assert held is not None
    assert held.groupBy("block_id").count().agg({"count": "max"}).first()[0] <= most
    assert held.filter("core").count() == pts.count()
    placed = blocks.settle(held, ["road_key"], cluster._in_batches, blocks.greedy_roles(radius), log=log)
    return as_dict(cluster._sum_up(pts, placed.select("road_key", *blocks.AT, *blocks.TO, "miles"), ["road_key"])), log


@pytest.mark.parametrize("ids", ["along", "random"])
def test_unbroken_road(spark, ids):
    items = road(1_200, 0.3, ids=ids, bend=0.05)
    got, log = settled(spark, items, 1.0, 150)
    assert got == wanted(items, 1.0)
    assert log[0] >= 8 and len(log) <= 8


def test_open_ground(spark):
    items = data.rows(900, 7, roads=("m1",), spread=0.6)
    got, log = settled(spark, items, 1.0, 200)
    assert got == wanted(items, 1.0)
    assert log[0] >= 4 and len(log) <= 8


def test_even_steps_cross_a_block_a_round(spark):
    """The worst order: every place is near the one before only, so that roles
    repeat in threes and a guess at a block's edge goes wrong two times in
    three. The rounds stay within the number of blocks."""
    items = road(240, 0.9, jitter=0.0)
    got, log = settled(spark, items, 1.0, 20)
    assert got == wanted(items, 1.0)
    assert len(log) <= log[0] + 1


@pytest.mark.parametrize("where", ["pole", "date line"])
def test_poles_and_date_line(spark, where):
    r = random.Random(9)
    items = data.rows(250, 8, roads=("m1",))
    for x in items:
        if where == "pole":
            x.update(lat=round(90 - r.uniform(0, 0.4), 5), lon=round(r.uniform(-180, 180), 4))
        else:
            x.update(lat=round(r.uniform(-0.3, 0.3), 5), lon=round((180 + r.uniform(-0.3, 0.3) + 180) % 360 - 180, 5))
    got, log = settled(spark, items, 2.0, 120)
    assert got == wanted(items, 2.0) and log[0] > 3


def test_dense_ground_does_not_fit(spark):
    items = data.rows(200, 13, roads=("m1",), spread=0.02)
    assert blocks.members(locs(spark, items), 1.0, ["road_key"], 50) is None
    assert as_dict(cluster.cluster_in_rounds(locs(spark, items), 1.0, 50)) == wanted(items, 1.0)


def test_slices_settle_by_blocks(spark, monkeypatch):
    """Dense ground beside open ground: slices, whose open part is cut."""
    used, settle = [], blocks.settle
    monkeypatch.setattr(blocks, "settle", lambda *a: used.append(1) or settle(*a))
    dense = data.rows(150, 13, roads=("m1",), spread=0.01, bearings=[5])
    items = dense + [dict(x, id=x["id"] + 1000) for x in road(500, 0.3)]
    assert as_dict(cluster.cluster_in_rounds(locs(spark, items), 1.0, 60)) == wanted(items, 1.0)
    assert used


@pytest.mark.parametrize("shape", ["diagonal", "ring", "towns"])
def test_ground_islands(spark, shape):
    r = random.Random(4)
    if shape == "diagonal":
        at = [(50 + i * 0.008, -1 + i * 0.008) for i in range(200)] + [(50 + i * 0.008, -0.9 + i * 0.008) for i in range(200)]
    elif shape == "ring":
        at = [(50 + math.cos(i / 30), -1 + 1.5 * math.sin(i / 30)) for i in range(189)] + [(50.0, -1.0)]
    else:
        at = [(50 + r.uniform(0, 9) + r.gauss(0, 0.003), r.uniform(0, 10)) for _ in range(60)]
        at = [(a + r.gauss(0, 0.003), b + r.gauss(0, 0.003)) for a, b in at for _ in range(6)]
    base = data.rows(1, 1, roads=("m1",), bearings=[5])[0]
    items = [base | {"id": i, "lat": a, "lon": b} for i, (a, b) in enumerate(at)]
    radius = {"diagonal": 1.0, "ring": 4.0, "towns": 1.0}[shape]
    placed = ground.assign_ground_islands(locs(spark, items), radius, ["road_key"]).collect()
    assert len(placed) == len(items)
    for i, a in enumerate(placed):
        for b in placed[:i]:
            if a["part_id"] != b["part_id"]:
                assert not plain.miles(a, b) <= radius
    found = len({p["part_id"] for p in placed})
    assert {"diagonal": found == 2, "ring": found == 2, "towns": 50 <= found <= 75}[shape]


def test_no_rows(spark):
    pts = locs(spark, road(3, 1.0)).filter("false")
    assert ground.assign_ground_islands(pts, 1.0, ["road_key"]).count() == 0
    assert blocks.members(pts, 1.0, ["road_key"], 10) is None


def bucketed(spark, items, radius, n_buckets, most):
    got = cluster.greedy_cluster_bucketed(locs(spark, items), radius, n_buckets, max_group_rows=most)
    return {x["hs_id"]: x["n"] for x in got.collect()}


def test_suppression_by_blocks(spark, monkeypatch):
    used, settle = [], blocks.settle
    monkeypatch.setattr(blocks, "settle", lambda *a, **k: used.append(a[0].columns) or settle(*a, **k))
    monkeypatch.setattr(cluster, "_moves_by_rounds", None)
    items = data.rows(900, 17, roads=("m1",), spread=0.5, bearings=[5])
    assert bucketed(spark, items, 1.5, 3, 100) == plain.bucketed(plain.locations(items), 1.5, 3, False)
    assert any("lone" in c for c in used)


def chain(spark, n, radius):
    """A lone place in each of n buckets, each near the one before only."""
    from pyspark.sql import functions as F

    rows = [(f"{i}", "m1", i, 50 + i * 0.9 * radius / 69.0, -1.0, 5, True, 1) for i in range(n)]
    df = spark.createDataFrame(rows, "seq string, road_key string, bucket_id int, lat double, lon double, bearing int, lone boolean, n long")
    return df.withColumn("seq", F.col("seq").cast("long"))


def test_a_chain_of_a_thousand_buckets(spark):
    first = chain(spark, 1_000, 1.0)
    # one falls, the next stands again
    for most in (20_000, 300):
        got = {r["at"]["seq"]: r["to"]["seq"] for r in cluster._moves(first, 1.0, most).collect()}
        assert got == {i: i - 1 for i in range(1, 1_000, 2)}
    held, log = blocks.members(first, 1.0, ["road_key"], 300, ["bucket_id", "lone"]), []

    def decide(pdf, by):
        from roadpulse.operators import in_order

        return in_order.suppress_groups(pdf, by, 1.0, pdf["given"].to_numpy())

    placed = blocks.settle(held, ["road_key"], cluster._in_batches, decide, ["bucket_id", *blocks.AT], log)
    assert placed.filter("role = 0").count() == 500 and len(log) <= 11


def test_dense_buckets_go_round_by_round(spark):
    items = data.rows(120, 19, roads=("m1",), spread=0.15, bearings=[5])
    assert bucketed(spark, items, 3.0, 40, 10) == plain.bucketed(plain.locations(items), 3.0, 40, False)

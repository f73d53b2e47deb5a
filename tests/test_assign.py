import pytest
from pyspark.sql import functions as F

from roadpulse.operators import assign
from tests import data, plain

LEFT = data.rows(400, 1, hot=0.35)
RIGHT = data.rows(40, 2)


@pytest.mark.parametrize("rows,limit", [(None, 0), (40, 100), (40, 10)])
@pytest.mark.parametrize("pick", ["nearest", "first"])
def test_assign_crisp(spark, rows, limit, pick):
    """The same with a broadcast, a sort-merge join and the planner's choice."""
    got = assign.assign_crisp(
        data.keyed(spark, LEFT), data.hotspots(spark, RIGHT), 3.0, pick, rows=rows, limit=limit
    )
    key = (lambda d, h: (d, h)) if pick == "nearest" else (lambda d, h: (h, d))
    want = {}
    for a in LEFT:
        near = [key(plain.miles(a, b), b["id"]) for b in RIGHT if plain.within(a, b, 3.0)]
        want[a["id"]] = (min(near)[1 if pick == "nearest" else 0] if near else None)
    assert {r["incident_id"]: r["hs_id"] for r in got.collect()} == want


@pytest.mark.parametrize("rows", [None, 40, 4])
def test_rows_that_share_an_id_stay_apart(spark, rows):
    items = [dict(x, id=x["id"] // 2) for x in LEFT]
    inc = data.keyed(spark, items).withColumn("incident_id", F.expr("nullif(incident_id, 3)"))
    got = assign.assign_crisp(inc, data.hotspots(spark, RIGHT), 3.0, rows=rows, limit=10)
    found = sorted(str((r["incident_id"], r["lat"], r["lon"], r["hs_id"])) for r in got.collect())
    want = []
    for x in items:
        near = [(plain.miles(x, b), b["id"]) for b in RIGHT if plain.within(x, b, 3.0)]
        want.append(str((None if x["id"] == 3 else x["id"], x["lat"], x["lon"], min(near)[1] if near else None)))
    assert found == sorted(want)


def test_join_path_sorts_no_pairs(spark):
    inc = data.keyed(spark, LEFT).repartition(3)
    got = assign.assign_crisp(inc, data.hotspots(spark, RIGHT), 3.0)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and plan.count("Exchange hashpartitioning") == 2
    seen = assign.tally(got)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in seen


def test_unassigned_and_counts(spark):
    inc, hs = data.keyed(spark, LEFT), data.hotspots(spark, RIGHT)
    done = assign.assign_crisp(inc, hs, 3.0)
    taken, left = assign.split_assigned(done)
    free = assign.unassigned_incidents(inc, hs, 3.0)
    assert {r[0] for r in free.select("incident_id").collect()} == {
        r[0] for r in left.select("incident_id").collect()
    }
    assert taken.count() + left.count() == len(LEFT)
    n = assign.count_updates(done).agg({"n": "sum"}).first()[0]
    assert n == taken.count()


def test_places_fold_before_matching(spark):
    places = assign.positions(data.keyed(spark, LEFT))
    assert places.agg({"n": "sum"}).first()[0] == len(LEFT)
    assert places.count() < len(LEFT) * 0.8


def test_fuzzy_pairs(spark):
    import math

    inc, hs = data.keyed(spark, LEFT), data.hotspots(spark, RIGHT)
    got = {
        (r["incident_id"], r["hs_id"]): r["membership"]
        for r in assign.assign_fuzzy(inc, hs, 4.0, 0.2).collect()
    }
    want = {}
    for a in LEFT:
        for b in RIGHT:
            if plain.within(a, b, 4.0):
                mu = math.exp(-0.5 * (plain.miles(a, b) / (0.5 + b["id"] % 4 * 0.5)) ** 2)
                if mu >= 0.2:
                    want[a["id"], b["id"]] = mu
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
    free = assign.unassigned_fuzzy(inc, hs, 4.0, 0.2)
    assert {r["incident_id"] for r in free.collect()} == {a["id"] for a in LEFT} - {
        k[0] for k in want
    }


def test_two_roads_at_one_place_stay_apart(spark):
    items = [
        {"id": 1, "lat": 50.0, "lon": 0.0, "bearing": 0, "road": "M1"},
        {"id": 2, "lat": 50.0, "lon": 0.0, "bearing": 0, "road": "m2"},
        {"id": 3, "lat": 50.0, "lon": 0.0, "bearing": 90, "road": "m1"},
    ]
    got = {r["seq"]: (r["road"], r["bearing"], r["n"]) for r in assign.new_locations(data.keyed(spark, items)).collect()}
    assert got == {1: ("M1", 0, 2), 2: ("m2", 0, 1)}


@pytest.mark.parametrize("at,spread", [((52.0, -1.0), 0.4), ((89.6, 0.0), 0.4), ((0.0, 179.8), 0.4), ((-89.95, 10.0), 0.04)])
def test_own_reach_loses_no_pair(spark, at, spread):
    """Narrow and wide spreads, one missing, near poles and the date line."""
    import math

    def wrapped(items):
        return [dict(x, lon=(x["lon"] + 180) % 360 - 180) for x in items]

    left = wrapped(data.rows(300, 71, roads=("m1",), spread=spread, at=at, bearings=[5]))
    right = wrapped(data.rows(40, 72, roads=("m1",), spread=spread, at=at, bearings=[5]))
    sds = {x["id"]: [0.15, 0.6, 2.75, None][x["id"] % 4] for x in right}
    table = spark.createDataFrame(list(sds.items()), "hs_id long, sd double")
    hs = data.hotspots(spark, right).drop("sd").join(table, "hs_id")
    want = set()
    for a in left:
        for b in right:
            d = plain.miles(a, b)
            if d <= 4.0 and math.exp(-0.5 * (d / (sds[b["id"]] or 1.0)) ** 2) >= 0.2:
                want.add((a["id"], b["id"]))
    assert len(want) > 50
    inc = data.keyed(spark, left)
    for rows, limit in ((None, 0), (40, 100), (40, 10)):
        got = assign.match_fuzzy(inc, hs, 4.0, 0.2, rows, limit).select("incident_id", "hs_id").collect()
        assert len(got) == len(set(got))
        assert {(r[0], r[1]) for r in got if r[1] is not None} == want
        assert {r[0] for r in got} == {a["id"] for a in left}

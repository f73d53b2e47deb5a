import math
import random

import pytest

from roadpulse.functions import geo
from roadpulse.operators.assign import candidate_pairs, road_pairs
from tests import data, plain


def one(spark, text):
    return spark.sql(f"select {text} as x").first()[0]


@pytest.mark.parametrize(
    "a,b,want,ok",
    [(350, 5, 15, True), (0, 60, 60, False), (0, 180, 180, False), (0, 359, 1, True),
     (0, 59, 59, True), (179, 0, 179, False), (720, 10, 10, True)],
)
def test_bearing(spark, a, b, want, ok):
    assert one(spark, geo.bearing_delta(str(a), str(b))) == want
    assert one(spark, geo.bearing_compatible(str(a), str(b))) is ok


def test_road_ignores_case_and_keeps_blanks(spark):
    assert one(spark, geo.same_road("'m1'", "'M1'"))
    assert not one(spark, geo.same_road("'M1'", "'M10'"))
    assert not one(spark, geo.same_road("'M1'", "'M1 '"))


def test_haversine(spark):
    got = one(spark, geo.haversine_miles("36.12D", "-86.67D", "33.94D", "-118.40D"))
    assert got == pytest.approx(2887.2599506071106 / 1.609344, rel=1e-12)
    assert one(spark, geo.haversine_miles("1D", "2D", "1D", "2D")) == 0.0


@pytest.mark.parametrize(
    "lat,lon,spread,r",
    [(52.0, -1.0, 0.3, 5.0), (0.0, 179.9, 0.3, 5.0), (-89.9, 0.0, 120.0, 20.0),
     (89.5, -180.0, 360.0, 40.0), (-45.0, -180.2, 0.5, 8.0), (10.0, 10.0, 60.0, 900.0)],
)
def test_grid_loses_no_pair(spark, lat, lon, spread, r):
    """Poles, the date line and radii from small to huge."""
    g = random.Random(1)

    def make(n, base):
        return [
            {"id": base + i, "lat": max(min(lat + g.uniform(-1, 1) * min(spread, 0.6 if spread > 1 and abs(lat) > 80 else spread) , 90.0), -90.0),
             "lon": (lon + g.uniform(0, spread) + 180) % 360 - 180, "bearing": 0, "road": "M1"}
            for i in range(n)
        ]

    left, right = make(150, 0), make(60, 1000)
    got = {
        (x[0], x[1])
        for x in candidate_pairs(data.keyed(spark, left), data.hotspots(spark, right), r)
        .select("incident_id", "hs_id").collect()
    }
    want = {(a["id"], b["id"]) for a in left for b in right if plain.within(a, b, r)}
    assert len(want) > 20
    assert got == want


def test_no_pair_comes_twice(spark):
    left, right = data.rows(200, 5), data.rows(40, 6)
    pairs = road_pairs(data.keyed(spark, left), data.hotspots(spark, right), 4.0)
    rows = [tuple(x) for x in pairs.select("incident_id", "hs_id").collect()]
    assert len(rows) == len(set(rows))
    want = {(a["id"], b["id"]) for a in left for b in right
            if a["road"].lower() == b["road"].lower() and plain.miles(a, b) <= 4.0}
    assert set(rows) == want
    assert math.isclose(geo.EARTH_MILES, plain.R)

"""Small random inputs."""

import random

from roadpulse.sources.incidents import keyed_incidents, with_seq


def rows(n, seed, roads=("m1", "M1", "A5"), spread=0.15, hot=0.0, bearings=range(0, 360, 10), at=(52.0, -1.0)):
    """Random incidents; a share `hot` of them lies at one place."""
    g = random.Random(seed)
    out = []
    for i in range(n):
        if g.random() < hot:
            lat, lon, road, bearing = at[0], at[1], "m1", 40
        else:
            lat = round(at[0] + g.random() * spread, 4)
            lon = round(at[1] + g.random() * spread, 4)
            road, bearing = g.choice(roads), g.choice(list(bearings))
        out.append({"id": i, "lat": lat, "lon": lon, "bearing": bearing, "road": road})
    g.shuffle(out)
    return out


SCHEMA = "incident_id long, lat double, lon double, bearing int, road string, interval_id int"


def frame(spark, items):
    data = [
        (x["id"], x["lat"], x["lon"], x["bearing"], x["road"], x.get("t", 1)) for x in items
    ]
    return spark.createDataFrame(data, SCHEMA)


def keyed(spark, items):
    return with_seq(keyed_incidents(frame(spark, items)))


def hotspots(spark, items):
    return (
        frame(spark, items)
        .withColumnRenamed("incident_id", "hs_id")
        .selectExpr("hs_id", "lower(road) as road_key", "road", "lat", "lon", "bearing",
                    "cast(1 + hs_id % 5 as double) as fitness", "1 as age",
                    "0.5 + (hs_id % 4) * 0.5D as sd")
    )

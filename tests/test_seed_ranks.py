import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from roadpulse.operators import ranks, seed
from tests import data


@pytest.mark.parametrize("n,percent", [(0, 10), (9, 10), (10, 10), (257, 10), (257, 100), (257, 0)])
def test_sample_is_the_lowest_hashes(spark, n, percent):
    items = data.rows(n, 3)
    chosen, rest = seed.seed_split(data.keyed(spark, items) if n else data.keyed(spark, data.rows(3, 1)).filter("false"), percent)
    got = sorted(r["incident_id"] for r in chosen.collect())
    order = sorted((x["id"] for x in items), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    assert got == sorted(order[: n * percent // 100])
    assert rest.count() == n - len(got)


@pytest.mark.parametrize("few", [10_000, 1])
def test_sample_size_with_repeated_and_missing_ids(spark, monkeypatch, few):
    monkeypatch.setattr(seed, "FEW", few)
    rows = [dict(x, id=x["id"] // 50) for x in data.rows(400, 8)]
    df = data.keyed(spark, rows)
    df = df.withColumn("incident_id", F.when(F.col("incident_id") != 2, F.col("incident_id")))
    chosen, rest = seed.seed_split(df)
    copies = df.groupBy("incident_id", "road", "lat", "lon", "bearing").count().agg({"count": "max"}).first()[0]
    assert 40 <= chosen.count() < 40 + copies
    assert chosen.count() + rest.count() == 400


@pytest.mark.parametrize("n", [1, 2, 10, 11, 100, 5000])
@pytest.mark.parametrize("kind", ["spread", "ties", "outliers"])
def test_ranks(spark, n, kind):
    g = random.Random(n)
    if kind == "spread":
        values = [g.gauss(0, 1) for _ in range(n)]
    elif kind == "ties":
        values = [0.15 if g.random() < 0.4 else round(g.random(), 1) for _ in range(n)]
    else:
        values = [10.0 ** g.randint(-5, 12) for _ in range(n)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    got = {r["p"]: r["value"] for r in ranks.rank_quantiles(df, "x").collect()}
    values.sort()
    assert got == {p: values[math.floor(p * n)] for p in ranks.PROBABILITIES}


def test_ranks_of_nothing(spark):
    got = ranks.rank_quantiles(spark.sql("select cast(1 as double) x").filter("false"), "x")
    assert [r["value"] for r in got.collect()] == [None] * 6

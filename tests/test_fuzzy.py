import math

import pytest

from roadpulse.checks.oracle import LEVELS, RULES
from roadpulse.functions import fuzzy
from tests import plain


def test_density_matches_plain(spark):
    grid = [(n, d / 20) for n in range(1, 14) for d in range(0, 60)]
    df = spark.createDataFrame(grid, "n long, d double")
    for base, rules in RULES.items():
        for r in fuzzy.with_density(df, "n", "d", base).collect():
            want = plain.density(r["n"], r["d"], rules, LEVELS)
            assert r["density"] == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize("n,term,want", [(8, "high", 1.0), (9, "high", 1.2), (10, "high", 1.0), (8, "med", 0.0), (3, "med", 1.0), (0, "low", 1.0)])
def test_count_terms(spark, n, term, want):
    assert spark.sql(f"select {fuzzy.count_term(str(n), term)} x").first()[0] == pytest.approx(want)


@pytest.mark.parametrize("d,term,want", [(0.75, "low", 0.0), (1.75, "med", 0.0), (2.0, "high", 1.0), (1.0, "med", 1.0), (1.25, "high", 0.0)])
def test_distance_terms(spark, d, term, want):
    assert spark.sql(f"select {fuzzy.distance_term(str(d) + 'D', term)} x").first()[0] == pytest.approx(want)


@pytest.mark.parametrize("x,want", [(0.285, 0.28), (1.005, 1.0), (0.125, 0.13), (1.446, 1.45)])
def test_round2(spark, x, want):
    assert spark.sql(f"select {fuzzy.round2(repr(x) + 'D')} x").first()[0] == want


def test_update_sd_matches_plain(spark):
    rows = [(i, sd, n, n * d) for i, (sd, n, d) in enumerate(
        (sd, n, d / 10) for sd in (None, 0.15, 1.0, 2.75) for n in (0, 1, 2, 5, 9, 10, 30) for d in range(0, 30))]
    df = spark.createDataFrame(rows, "i int, sd double, n_added long, dist_sum double")
    got = {r["i"]: r for r in fuzzy.update_sd(df, 0.3).collect()}
    for i, sd, n, total in rows:
        want = plain.new_sd(sd, n, total, 0.3, RULES["tight"], LEVELS)
        assert (got[i]["sd"], got[i]["density_label"]) == (pytest.approx(want[0]), want[1])


@pytest.mark.parametrize("steps", [1, 2, 5])
@pytest.mark.parametrize("decay", [0.03, 0.3])
def test_idle_steps_round_each_time(spark, steps, decay):
    df = spark.createDataFrame([(0.15,), (1.2,), (2.7,)], "sd double")
    for before, after in zip([0.15, 1.2, 2.7], fuzzy.idle_spread(df, decay, steps).collect()):
        label = None
        for _ in range(steps):
            before, label = plain.new_sd(before, 0, 0.0, decay, None, None)
        assert (after["sd"], after["density_label"]) == (pytest.approx(before), label)


def test_membership(spark):
    def m(d, sd):
        return spark.sql(f"select {fuzzy.membership(d, sd, 5.0)} x").first()[0]

    assert m("0D", "1D") == 1.0
    assert m("5.0001D", "9D") == 0.0
    assert m("cast(null as double)", "1D") == 0.0
    assert m("1D", "cast(null as double)") == pytest.approx(math.exp(-0.5))


def test_effective_radius(spark):
    def reach(sd, top, conf=0.2):
        return spark.sql(f"select {fuzzy.effective_radius(sd, top, conf)} x").first()[0]

    wide = math.sqrt(-2 * math.log(0.2))
    assert reach("2.75D", 9.0) == pytest.approx(2.75 * wide)
    assert reach("2.75D", 4.0) == 4.0
    assert reach("cast(null as double)", 9.0) == pytest.approx(wide)
    assert reach("2.75D", 9.0, 1.0) == 0.0

import math
import random

import numpy as np
import pytest

from roadpulse.llm import whitening as W
from roadpulse.llm.common import table

SCHEMA = "vec_id long, embedding array<float>, label int, key string, n long, x array<int>"


def vectors(spark, rows):
    return spark.createDataFrame([(i, e, 0, "k", 7, [1]) for i, e in rows], SCHEMA)


def slow(rows, k=8, one=False):
    """Per row: vec_id, n, deviation, coordinates, shares, by plain sums."""
    rows = [(i, [math.floor(1024 * float(np.float32(c))) + 100_000 for c in e]) for i, e in rows]
    fit = [list(x) for x in {tuple(x) for _, x in rows}] if one else [x for _, x in rows]
    n, d = len(fit), len(fit[0])
    s = [sum(x[j] for x in fit) for j in range(d)]
    y = np.array([[n * x[j] - s[j] for j in range(d)] for x in fit], float) / n
    v = y.T @ y / n
    e, axes = np.linalg.eigh(v)
    e, axes = e[::-1][:k], axes.T[::-1][:k]
    out = []
    for i, x in rows:
        z = [n * x[j] - s[j] for j in range(d)]
        out.append((i, n, sum(a * a for a in z), (np.array(z, float) / n) @ axes.T / np.sqrt(e), e / np.trace(v)))
    return out


def check(got, want, k):
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], []).append(r)
    assert len(got) == len(want) * k
    signs = {}
    for i, n, deviation, at, shares in want:
        rs = sorted({r["component"]: r for r in by[i]}.values(), key=lambda r: r["component"])
        assert [r["component"] for r in rs] == list(range(1, k + 1))
        for r, a, share in zip(rs, at, shares, strict=True):
            assert (r["n"], r["deviation"]) == (n, deviation)
            if abs(a) > 1e-6:
                sign = math.copysign(1, a * r["whitened"])
                assert signs.setdefault(r["component"], sign) == sign
            assert abs(abs(r["whitened"]) - abs(a)) < 1e-8
            assert abs(r["explained"] - share) <= 1e-9
            assert r["identity_error"] < 1e-9


def random_rows(n, d, seed):
    r = random.Random(seed)
    rows = [(i, [r.gauss(0, 0.1 * (j + 1)) for j in range(d)]) for i in range(n)]
    # a third of all rows share one vector
    return [(i, rows[0][1]) if i % 3 == 0 else (i, e) for i, e in rows]


@pytest.mark.parametrize("weights", ["counts", "one"])
def test_matches_plain_sums(spark, weights):
    rows = random_rows(300, 11, 1)
    got = W.whitened_rows(vectors(spark, rows), weights=weights).collect()
    check(got, slow(rows, one=weights == "one"), 8)


def test_whole_table(spark):
    df = table(spark, "/root/testdata/sf0.01", "embeddings")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    check(W.whitened_rows(df).collect(), slow(rows), 8)


def test_common_and_rare_vectors_both_join(spark):
    # with 3,000 rows a vector of four is common, one of three is not
    rows = [(i, [float(i // 3 % 900), float(i % 900 == 1), 0.5 * (i % 7)]) for i in range(2_000)]
    rows += [(2_000 + i, [7.0, 7.0, 7.0]) for i in range(1_000)]
    got = W.whitened_rows(vectors(spark, rows)).collect()
    check(got, slow(rows, 3), 3)


def test_edges(spark):
    rows = random_rows(40, 5, 2)
    bad = [(100, None), (101, [None, 1.0, 1.0, 1.0, 1.0]), (102, [math.nan] * 5), (103, [math.inf, 0.0, 0.0, 0.0, 0.0])]
    bad += [(104, []), (105, [1.0]), (106, [1e30, 0.0, 0.0, 0.0, 0.0])]
    got = W.whitened_rows(vectors(spark, [*rows, *bad])).collect()
    check(got, slow(rows, 5), 5)
    # null and repeated ids keep a row each
    got = W.whitened_rows(vectors(spark, [*rows, (None, rows[1][1]), (3, rows[3][1])])).collect()
    assert len(got) == 42 * 5 and sum(r["vec_id"] is None for r in got) == 5
    for empty in ([], [(1, None)], bad[:1]):
        df = W.whitened_rows(vectors(spark, empty))
        assert df.count() == 0 and df.columns[:2] == ["vec_id", "component"]


def test_no_variance(spark):
    got = W.whitened_rows(vectors(spark, [(i, [1.0, 2.0, 3.0]) for i in range(4)])).collect()
    assert len(got) == 12
    assert {(r["whitened"], r["explained"], r["identity_error"], r["deviation"]) for r in got} == {(None, None, None, 0)}
    got = W.whitened_rows(vectors(spark, [(i, [float(i), 2.0]) for i in range(4)])).collect()
    one, two = ([r for r in got if r["component"] == c] for c in (1, 2))
    assert all(r["whitened"] is None and r["explained"] == 0 for r in two)
    assert all(r["explained"] == 1 and r["identity_error"] < 1e-9 for r in one)


def test_large_entries_stay_exact(spark):
    rows = [(i, [float(v), float(-v)]) for i, v in enumerate([2**38, 2**37, 5, 9, 2**36])]
    got = W.whitened_rows(vectors(spark, rows), k=1).collect()
    want = slow(rows, 1)
    assert all(r["deviation"] is None for r in got) and want[0][2] >= 1 << 63
    assert got[0]["explained"] == pytest.approx(1.0)

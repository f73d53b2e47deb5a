import math
import random
import zlib

import numpy as np
import pytest

from roadpulse.llm import classifier as C
from roadpulse.llm.common import table

from .fixtures import edge_docs, no_docs, prose

LABELS = "doc_id long, quality int, toxic int, text string"


def held(doc_id):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 5 == 0


def slow_grams(text):
    """The n-grams by their definition, token by token."""
    tokens, i, text = [], 0, text or ""

    def kind(c):
        return "s" if c.isspace() else "_" if c == "_" else "d" if c.isdecimal() else "a" if c.isalnum() else "p"

    while i < len(text):
        k, j = kind(text[i]), i
        while j < len(text) and kind(text[j]) == k:
            j += 1
        if k != "s":
            tokens.append(text[i:j])
        i = j
    shapes = C._Shapes()
    kinds = [C.MARK + "=" if i and tokens[i - 1] == t else shapes[t] for i, t in enumerate(tokens)]
    out = set(tokens) | set(kinds)
    for seq, most in ((tokens, 2), (kinds, 3)):
        out |= {tuple(seq[i : i + n]) for n in range(2, most + 1) for i in range(len(seq) - n + 1)}
    return out


def test_grams():
    for text in (None, "", "  ", "One one one, TWO!! x_1 42 42 \n a", "é ñ 你好 你好 \U0001f600 x\x1cy", prose(200, 3), "### $$$ %%% " * 20):
        assert C.grams(text, C._Shapes()) == slow_grams(text)
    assert (C.MARK + "=", C.MARK + "=") in C.grams("go go go", C._Shapes())


def test_descent_meets_the_dual_optimum():
    r = random.Random(1)
    rows = [np.array(sorted(r.sample(range(12), 5))) for _ in range(60)]
    good = np.array([(a < 4).sum() > 1 for a in rows])
    scale = C.log_ratios(rows, good, 12)
    for held in (True, False):
        some = [a for a, g in zip(rows, good, strict=True) if g == held]
        p = np.array([sum(j in a for a in some) for j in range(12)]) + C.SMOOTH
        part = np.log(p / p.sum())
        total = part if held else total - part
    assert np.allclose(scale, total)
    weights, constant = C.descend(rows, good, scale, cost=1.0, passes=3000)
    # No small change of the weights lowers the primal objective.
    x = np.array([[scale[j] * (j in a) for j in range(12)] for a in rows])
    y, cost = np.where(good, 1, -1), 0.5 / np.where(good, good.mean(), 1 - good.mean())
    w = np.divide(weights, scale, out=np.zeros(12), where=scale != 0)

    def primal(w, b):
        return 0.5 * (w @ w + b * b) + (cost * np.maximum(0, 1 - y * (x @ w + b))).sum()

    best, random_ = primal(w, constant), np.random.default_rng(2)
    for size in (1e-1, 1e-2, 1e-3):
        for _ in range(200):
            step = random_.normal(size=13) * size
            assert primal(w + step[:12], constant + step[12]) >= best - 1e-3


def test_held_out_quality(spark):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    got = C.scored(docs, labels).toPandas().set_index("doc_id")
    assert len(got) == docs.count()
    assert got["score"].between(0, 1).all()
    assert ((got["score"] >= 0.3) == (got["predicted"] == 1)).all()
    assert all(held(i) == h for i, h in zip(got.index, got["held_out"], strict=True))
    truth = labels.toPandas().set_index("doc_id")["quality"]
    test = got[got["held_out"]].join(truth, how="inner")
    right = (test["predicted"] == test["quality"]).mean()
    ones, zeros = (test[test["quality"] == q]["score"].to_numpy() for q in (1, 0))
    auc = (ones[:, None] > zeros[None, :]).mean() + 0.5 * (ones[:, None] == zeros[None, :]).mean()
    print(len(test), right, auc, (test[test.quality == 1].predicted == 1).mean(), (test[test.quality == 0].predicted == 0).mean())
    assert right > 0.9 and auc > 0.9
    assert (test[test["quality"] == 1]["predicted"] == 1).mean() > 0.95


def test_labels_of_held_out_rows_are_not_read(spark):
    docs, labels = table(spark, "/root/testdata/sf0.001", "documents"), table(spark, "/root/testdata/sf0.001", "labels")
    rows = [(r["doc_id"], r["quality"], 0, "t") for r in labels.collect()]
    turned = [(i, 1 - q if held(i) else q, 0, "t") for i, q, _, _ in rows]
    a, b = (C.scored(docs, spark.createDataFrame(r, LABELS)).collect() for r in (rows, turned))
    assert sorted(map(tuple, a)) == sorted(map(tuple, b)) and len(a) == docs.count()


def test_edges(spark):
    docs, rows = edge_docs(spark, [prose(60, i) if i % 3 else "### $$$ " * 30 for i in range(60)] + [None, "", "é" * 200_000])
    labels = [(i, int(i % 3 > 0), 0, "x") for i in range(60)] + [(None, 1, 0, "x"), (3, None, 0, "x"), (4, 7, 0, "x"), (5, 0, 0, "x"), (5, 1, 0, "x")]
    got = C.scored(docs, spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == len(rows)
    assert sum(r["doc_id"] is None for r in got) == 1 and sum(r["doc_id"] == 0 for r in got) == 2
    by = {r["doc_id"]: r for r in got}
    assert by[60]["score"] == by[61]["score"]
    assert by[1]["predicted"] == 1 and by[0]["predicted"] == 0
    weights, constant = C.fit(docs, spark.createDataFrame(labels, LABELS))
    for r in rows:
        total = constant + sum(weights.get(g, 0.0) for g in slow_grams(r[1]))
        assert by[r[0]]["score"] == pytest.approx(1 / (1 + math.exp(-total)))
    assert C.scored(no_docs(spark), spark.createDataFrame(labels, LABELS)).count() == 0
    # no labels, or one class only
    assert {r["score"] for r in C.scored(docs, spark.createDataFrame([], LABELS)).collect()} == {0.5}
    one = C.scored(docs, spark.createDataFrame([r for r in labels if r[1] == 1], LABELS)).collect()
    assert {r["predicted"] for r in one} == {1}

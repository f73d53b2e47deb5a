import random

import numpy as np
import pytest
import xxhash

from roadpulse.llm import simhash_dedup as S

from .fixtures import edge_docs, edge_texts, no_docs, prose


def slow_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    runs = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_roots(fps, radius=3):
    roots = list(range(len(fps)))

    def top(i):
        while roots[i] != i:
            i = roots[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                roots[top(i)] = top(j)
    return [top(i) for i in range(len(fps))]


def test_fingerprint():
    for t in [*edge_texts(), prose(70_000, 5)]:
        assert S.fingerprint(t) == slow_fingerprint(t)


def test_near_duplicates(spark):
    docs, rows = edge_docs(spark)
    fps = [slow_fingerprint(r[1]) for r in rows]
    roots = slow_roots(fps)
    want = []
    for r, fp, root in zip(rows, fps, roots, strict=True):
        ids = [x[0] for x, q in zip(rows, roots, strict=True) if q == root and x[0] is not None]
        want.append((r[0], f"{fp:016x}", min(ids, default=None)))
    got = [tuple(r) for r in S.near_duplicates(docs).select("doc_id", "fingerprint", "component_id").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    kept = S.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    left = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert len(left) == len(set(roots))
    assert {i for i, _ in left if i is not None} == {c for _, _, c in want if c is not None}


def test_empty(spark):
    assert S.near_duplicates(no_docs(spark)).count() == 0
    assert S.drop_near_duplicates(no_docs(spark)).count() == 0


@pytest.mark.parametrize(("block", "parts"), [(4, 4), (1024, 4), (1024, 3), (8, 2)])
def test_links_connect_what_brute_force_connects(spark, monkeypatch, block, parts):
    allocate = S.allocate
    monkeypatch.setattr(S, "allocate", lambda sample, n, radius: allocate(sample, {4: 10, 3: 10**8, 2: 10**10}[parts], radius))
    assert len(S.allocate(np.random.default_rng(2).integers(0, 2**63, 2000).astype(np.uint64), 0, 3)) == parts
    r = random.Random(4)
    fps = [r.getrandbits(64) for _ in range(60)]
    for f in fps[:10]:  # chains and crowded groups
        for _ in range(30):
            for b in r.sample(range(64), r.randint(1, 3)):
                f ^= 1 << b
            fps.append(f)
    fps = sorted(set(fps))
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    edges = S.links(spark.createDataFrame([(x,) for x in signed], "fp long"), block=block)
    found = {x["node"]: x["root"] for x in S.components(edges).collect()}
    mine = [found.get(x, x) for x in signed]
    want = slow_roots(fps)
    pairs = {(a, b) for a, b in zip(mine, want, strict=True)}
    assert len(pairs) == len(set(mine)) == len(set(want))


def test_every_plan_covers_the_radius():
    r = np.random.default_rng(1)
    for n in (10, 10**6, 10**9, 10**12):
        plan = S.allocate(r.integers(0, 2**63, 500).astype(np.uint64), n)
        bits = sorted(b for part, _ in plan for b in part)
        assert len(bits) == len(set(bits))
        # Parts left out count -1 each; all of them add up to radius - m + 1.
        assert sum(t + 1 for _, t in plan) == S.RADIUS + 1

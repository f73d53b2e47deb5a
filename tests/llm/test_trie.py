import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from roadpulse.llm import trie as T
from roadpulse.llm.common import table

SCHEMA = "conv_id long, turn long, role string, text string, ka long, n long, path string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "p") for r in rows], SCHEMA)


def slow(rows):
    """The trie by its definition: one dictionary of prefixes."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    said = {c: [x[2:] for x in sorted(ts, key=lambda x: x[:2])] for c, ts in own.items()}
    built = {}
    for c, ts in said.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(said.get(c - c % 100, [])[:h]) + tuple(ts[h:])
    # A tree of numbered nodes, so that long conversations stay cheap.
    child, up, depth, text, members, at_end = {}, [None], [0], [""], defaultdict(list), defaultdict(list)
    for c in sorted(built):
        v = 0
        members[v].append(c)
        for turn in built[c]:
            if (v, turn) not in child:
                child[v, turn] = len(up)
                up.append(v), depth.append(depth[v] + 1), text.append(turn[1])
            v = child[v, turn]
            members[v].append(c)
        at_end[v].append(c)
    if not built:
        return []
    kids, leaves, saved = [0] * len(up), [0] * len(up), [0] * len(up)
    for v in range(len(up) - 1, -1, -1):
        leaves[v] += kids[v] == 0
        saved[v] += (len(members[v]) - 1) * len(text[v])
        if v:
            kids[up[v]] += 1
            leaves[up[v]] += leaves[v]
            saved[up[v]] += saved[v]
    out = []
    for v in range(len(up)):
        sha = hashlib.sha256(",".join(map(str, at_end[v])).encode()).hexdigest()
        parent = members[up[v]][0] if v else None
        out.append((members[v][0], depth[v], parent, len(members[v]), kids[v], leaves[v], saved[v], sha))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def random_rows(n, seed, words=3, longest=9):
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(-50, 450), n):
        for t in range(r.randint(1, longest)):
            rows.append((c, t, r.choice(["user", "assistant"]) if words > 2 else "user", "w" * r.randint(0, words)))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("shard_rows", [None, 1, 3])
def test_matches_plain_trie(spark, shard_rows):
    rows = random_rows(150, 5, words=2)
    # a third of all conversations begin alike, and many are equal
    rows += [(c, t, "user", f"same {t}") for c in range(1000, 1060) for t in range(7)]
    rows += [(c, 7 + t, "user", f"own {c % 9} {t}") for c in range(1000, 1030) for t in range(3)]
    assert found(T.prefix_trie(frame(spark, rows), shard_rows, packed_rows=20)) == slow(rows)


def test_long_conversations_are_cut_into_segments(spark, monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 2)
    rows = [(0, t, "user", f"a{t}") for t in range(400)]
    rows += [(c, t, "user", f"a{t}" if t < share else f"b{c} {t}") for c, share in ((1, 64), (2, 63), (3, 65), (4, 128), (5, 200), (6, 330)) for t in range(share + (c % 3) * 70)]
    rows += [(c, t, "user", f"a{t}") for c in (7, 8, 9) for t in (range(64), range(128), range(400))[c - 7]]
    want = slow(rows)
    for shard_rows in (None, 1):
        assert found(T.prefix_trie(frame(spark, rows), shard_rows)) == want


def test_edges(spark):
    long = "é\U0001f600" * 50_000
    rows = [
        (5, None, "user", "first"), (5, 2, None, None), (5, 1, "user", long), (5, 3, "", ""),
        (6, 0, "user", "x"), (6, 1, "user", "y"),
        (None, 0, "user", "lost"), (150, 1, None, None), (151, 1, None, None), (100, 0, "", ""),
        (2**60 + 1, 0, "user", "z"),
    ]
    rows += [(7, 4, "user", "again")] * 3 + [(8, None, "user", "again")] * 3
    rows += [(c, 0, "user", "only") for c in range(300, 330)]
    assert found(T.prefix_trie(frame(spark, rows))) == slow(rows)
    for none in ([], rows[6:7]):
        assert T.prefix_trie(frame(spark, none)).collect() == []


def test_double_array_holds_what_was_added():
    r, trie, want = random.Random(3), T.DoubleArray(), {}
    states, codes = [0], list(range(300))
    for _ in range(200):
        s = states.pop(r.randrange(len(states)))
        mine = sorted(r.sample(codes, r.randint(1, 20)))
        trie.add(s, mine)
        to = trie.step(np.full(len(mine), s), np.array(mine)).tolist()
        want.update({(s, c): t for c, t in zip(mine, to, strict=True)})
        states += to
    assert len(set(want.values())) == len(want)
    for s in {s for s, _ in want}:
        assert [want.get((s, c), -1) for c in codes] == trie.step(np.full(300, s), np.array(codes)).tolist()
    # gaps are filled
    assert (trie.check >= 0).sum() > 0.3 * np.flatnonzero(trie.check >= 0).max()


def test_whole_table_and_sql(spark):
    df = table(spark, "/root/testdata/sf0.01", "conversations")
    got = found(T.prefix_trie(df))
    assert got == slow([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
    con = duckdb.connect()
    con.execute("create view conversations as select * from '/root/testdata/sf0.01/conversations.parquet'")
    rows = con.sql(T.ORACLE_SQL)
    assert rows.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(rows.fetchall(), key=str) == got

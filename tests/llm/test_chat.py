from roadpulse.llm import chat


def said(turns):
    order = sorted(turns, key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "user", t[3] or ""))
    return [(t[2] or "user", t[3] or "") for t in order]


def test_collapse(spark):
    rows = []
    base = [("user", "hi"), ("assistant", "hello"), ("user", None), (None, "more"), ("assistant", "x" * 100_000)]
    for i in range(1, 6):  # snapshots of one conversation
        rows += [(i, k, r, t) for k, (r, t) in enumerate(base[:i])]
    rows += [(10, k * 5, r, t) for k, (r, t) in enumerate(base)]  # equal, other numbers
    rows += [(11, 0, "user", "hi"), (11, 1, "assistant", "other")]
    rows += [(12, 0, "user", "hi"), (12, 0, "user", "hi")]  # repeated rows
    rows += [(None, None, "user", "hi"), (None, 1, "assistant", "alone")]
    rows += [(13, 0, "assistant", "hi")]
    rows += [(20, k, "user", f"turn {k}") for k in range(500)]  # spans ranges
    rows += [(21, k, "user", f"turn {k}") for k in range(499)]
    turns = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, part int")
    got = chat.collapse_and_render(turns).collect()
    convs = {c: said([r for r in rows if r[0] == c]) for c in {r[0] for r in rows}}
    kept = {}
    for c, s in convs.items():
        longer = any(len(o) > len(s) and o[: len(s)] == s for o in convs.values())
        twin = any(o == s and d is not None and c is not None and d < c for d, o in convs.items())
        if not longer and not twin:
            kept[c] = s
    mine = {}
    for r in sorted(got, key=lambda r: r["position"]):
        mine.setdefault(r["conv_id"], []).append((r["role"], r["rendered"]))
        assert r["n_turns"] == len(convs[r["conv_id"]])
    assert {c: [(r, f"<|im_start|>{r}\n{t}<|im_end|>\n") for r, t in s] for c, s in kept.items()} == mine
    assert chat.collapse_and_render(turns.limit(0)).count() == 0

import random

import pytest

from roadpulse.llm import near_copies as N
from roadpulse.llm.common import table

from .fixtures import edge_docs, no_docs, prose


def slow_shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similarity(a, b):
    return 1.0 if not a | b else len(a & b) / len(a | b)


def changed(text, share, seed):
    r, words = random.Random(seed), text.split()
    for i in r.sample(range(len(words)), int(share * len(words))):
        words[i] = f"new{r.random()}"
    return " ".join(words)


def test_shingles():
    for t in (None, "", "A b", "a b c d e", "a B c d e f a b c d e", prose(9_000, 4)):
        assert len(N.shingles(t)) == len(slow_shingles(t))


def group_of(df):
    return {r["doc_id"] for r in df.collect()}


def test_groups_keep_their_smallest(spark):
    base = [prose(200, 50 + i) for i in range(6)]
    texts = base + [changed(b, 0.015, i) for i, b in enumerate(base)] + [b.upper() for b in base] + [changed(b, 0.3, 9) for b in base]
    docs, rows = edge_docs(spark, texts)
    kept = N.drop_near_copies(docs)
    assert kept.columns == docs.columns
    got = group_of(kept)
    assert got == {*range(6), *range(18, 24), None}
    assert kept.count() == len(got)


def test_a_common_passage_links_nothing(spark):
    passage = prose(150, 1)
    texts = [f"{passage} {prose(90, 100 + i)}" for i in range(150)] + [prose(200, 7)] * 80 + [changed(prose(300, 8), 0.01, i) for i in range(80)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(group_of(N.drop_near_copies(docs)))
    assert got == [*range(150), 150, 230]


def test_edges(spark):
    docs, rows = edge_docs(spark)
    got = N.drop_near_copies(docs).collect()
    # the first text, without words, short ones, and all others that differ
    assert len([r for r in got if not slow_shingles(r["text"])]) == 1
    for i, a in enumerate(got):
        for b in got[:i]:
            assert similarity(slow_shingles(a["text"]), slow_shingles(b["text"])) < 0.8
    left = {frozenset(slow_shingles(r["text"])) for r in got}
    assert all(any(similarity(slow_shingles(r[1]), s) >= 0.8 for s in left) for r in rows)
    assert N.drop_near_copies(no_docs(spark)).count() == 0


def near_pairs(sets):
    """All pairs of different sets with a similarity of 0.8 or more, exactly: a
    common shingle lies among the rarest fifth of each."""
    count = {}
    for s in sets:
        for x in s:
            count[x] = count.get(x, 0) + 1
    seen, out = {}, []
    for i in sorted(range(len(sets)), key=lambda i: len(sets[i])):
        s = sets[i]
        rare = sorted(s, key=lambda x: (count[x], x))[: len(s) - -(-4 * len(s) // 5) + 1]
        for j in {j for x in rare for j in seen.get(x, ())}:
            if 0.8 <= similarity(s, sets[j]) < 1:
                out.append((i, j))
        for x in rare:
            seen.setdefault(x, []).append(i)
    return out


@pytest.mark.parametrize("sf, least", [("sf0.1", 0.9)])
def test_recall(spark, sf, least):
    docs = table(spark, f"/root/testdata/{sf}", "documents")
    rows = [(r["doc_id"], slow_shingles(r["text"])) for r in docs.collect()]
    got = group_of(N.drop_near_copies(docs))
    first, sets = [], {}
    for d, s in sorted(rows, key=lambda r: r[0]):
        if len(s) > 45 and frozenset(s) not in sets:
            sets[frozenset(s)] = d
            first.append((d, s))
    pairs = near_pairs([s for _, s in first])
    caught = sum(not (first[i][0] in got and first[j][0] in got) for i, j in pairs)
    print(len(pairs), caught)
    assert len(pairs) > 40 and caught >= least * len(pairs)
    # Nothing goes without a similar text that stays, or is linked to one.
    texts = dict(rows)
    near = {first[i][0] for p in pairs for i in p}
    for d, s in rows:
        if d not in got:
            assert sets.get(frozenset(s), d) != d or len(s) <= 45 or d in near, (d, len(texts[d]))

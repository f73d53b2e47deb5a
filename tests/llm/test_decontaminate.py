from collections import Counter

from roadpulse.llm import decontaminate as D

from .fixtures import edge_docs, no_docs, prose


def slow(docs, items):
    """Every window of every length against every item."""
    out = {}
    for doc_id, text in docs:
        w = (text or "").lower().split()
        for item_id, item in items:
            v = (item or "").lower().split()
            if not v or not w:
                continue
            k = min(5, len(v))
            want = Counter(tuple(v[i : i + k]) for i in range(len(v) - k + 1))
            for s in range(max(1, len(w) - len(v) + 1)):
                part = w[s : s + len(v)]
                have = Counter(tuple(part[i : i + k]) for i in range(len(part) - k + 1))
                union = sum((have | want).values())
                sim = sum((have & want).values()) / union if union else 0
                if sim >= 0.8 and sim > out.get((doc_id, item_id), (0, 0))[0]:
                    out[doc_id, item_id] = (sim, s)
    return out


def test_against_brute_force(spark):
    items = [(i, prose(14 + 3 * i, 500 + i)) for i in range(12)]
    items += [(100, "two words"), (101, ""), (102, None), (103, "a b c d e"), (None, prose(40, 700)), (104, "x y " * 15)]
    texts = []
    for i, item in items[:12]:
        w = item.split()
        texts.append(prose(50, i) + " " + item.upper() + " " + prose(30, i + 1))
        texts.append(item)
        texts.append(" ".join(w[1:]))
        texts.append(" ".join(w[:-1]) + " " + prose(40, 3 * i))
        texts.append(prose(20, i) + " " + " ".join([*w[: len(w) // 2], "inserted", *w[len(w) // 2 :]]))
        texts.append(prose(20, i) + " " + " ".join([*w[:2], "other", *w[3:]]) + " tail words here")
        texts.append(" ".join(w[: len(w) // 2]) + " " + prose(60, i))
    texts += ["two words", "here are two words", "x y " * 40, items[16][1], items[16][1], "a b c d e f"]
    docs, rows = edge_docs(spark, texts)
    got = D.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    mine = {(r["doc_id"], r["item_id"]): (r["similarity"], r["start_word"]) for r in got}
    want = slow([(r[0], r[1]) for r in rows], items)
    assert len(mine) == len(got)
    assert {k: round(v[0], 9) for k, v in mine.items()} == {k: round(v[0], 9) for k, v in want.items()}
    left = D.drop_contaminated(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert left.columns == docs.columns
    hit = {d for d, _ in want}
    assert sorted(str(r["doc_id"]) for r in left.collect()) == sorted(str(r[0]) for r in rows if r[0] not in hit)


def test_empty_tables_and_shuffled_items(spark, monkeypatch):
    items = spark.createDataFrame([(1, prose(30, 1))], "item_id long, text string")
    docs, rows = edge_docs(spark)
    assert D.contaminated(no_docs(spark), items).count() == 0
    assert D.contaminated(docs, items.limit(0)).count() == 0
    assert D.drop_contaminated(docs, items.limit(0)).count() == len(rows)
    monkeypatch.setattr(D, "SHIP_ROWS", 0)
    monkeypatch.setattr(D, "cut_lineage", lambda df: df)
    more = spark.createDataFrame([(7, "pre " + prose(30, 1) + " post")], "doc_id long, text string")
    assert [tuple(r) for r in D.contaminated(more, items).collect()] == [(7, 1, 1.0, 1)]

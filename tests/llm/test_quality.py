from collections import Counter

import numpy as np

from roadpulse.llm import quality as Q

from .fixtures import edge_docs, no_docs, prose

SPACE = " \t\n\x0b\x0c\r"


def slow_stats(text):
    text = text or ""
    words, word = [], ""
    for c in text + " ":
        if c in SPACE:
            if word:
                words.append(word)
            word = ""
        else:
            word += c
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    dup = len(lines) - len(set(lines))
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_statistics(spark):
    docs, rows = edge_docs(spark)
    got = Q.judged(docs, labels(spark, [(0, 1, 0), (None, 0, 0), (3, None, 0)])).collect()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    mine = [(r["doc_id"], *[r[c] for c in names]) for r in got]
    assert sorted(mine, key=str) == sorted(((r[0], *slow_stats(r[1])) for r in rows), key=str)
    assert all(r["kept"] == (not r["base_failed"]) for r in got)
    assert Q.judged(no_docs(spark), labels(spark, [])).count() == 0


def test_learned_list(spark):
    texts = [prose(80, i) if i % 3 else " ".join(f"{w}##" for w in prose(80, i).split()) for i in range(150)]
    docs, rows = edge_docs(spark, texts)
    lab = labels(spark, [(i, int(i % 3 > 0), 0) for i in range(120)])
    kept = Q.keep_good(docs, lab)
    assert kept.columns == docs.columns
    want = sorted(str(r[0]) for r in rows if r[0] is None or r[0] % 3)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == want


def test_conjunction():
    r = np.random.default_rng(5)
    n = 4000
    stats = {k: r.integers(0, 100, n) for k in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")}
    x = Q.features(stats)
    bad = (x["n_words"] > 60) & (x["n_words"] <= 90) & (x["words_per_line"] > 2)
    rules = Q.learn(stats, bad, r.permutation(n))
    found = np.zeros(n, bool)
    for rule in rules:
        found |= Q._cover(rule, x, n)
    assert (found & bad).sum() > 0.8 * bad.sum() and (found & ~bad).sum() < 0.05 * bad.sum()


def test_noise_teaches_nothing():
    r = np.random.default_rng(6)
    stats = {k: r.integers(0, 100, 1000) for k in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")}
    assert Q.learn(stats, r.random(1000) < 0.2, r.permutation(1000)) == []

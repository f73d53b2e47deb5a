"""The pipeline against plain Python over the same rows."""

import corpus_pipeline
from tokenizers import Tokenizer

import __spark_entry__
from roadpulse.llm.queries import ORACLE, QUERIES
from roadpulse.llm.tokens import tokenizer_path

from .fixtures import edge_docs, no_docs
from .test_decontaminate import slow
from .test_near_copies import near_pairs, slow_shingles
from .test_quality import slow_stats
from .test_secrets import slow_base

SF = "/root/testdata/sf0.01"


def test_registered():
    found = __spark_entry__.queries()
    assert set(QUERIES) | {"pipeline"} <= set(found)
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))
    assert set(ORACLE) <= set(QUERIES)


def test_pipeline(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = []
    for d, t in docs:
        s = slow_stats(t)
        # What the labels teach on this table: documents with symbols are bad.
        if not s[5] and s[2] <= 0.1 * s[0]:
            kept.append((d, t))
    sets = [slow_shingles(t) for _, t in kept]
    roots = list(range(len(kept)))

    def top(i):
        while roots[i] != i:
            i = roots[i]
        return i

    same = {}
    for i, s in enumerate(sets):
        roots[i] = same.setdefault(frozenset(s), i)
    for i, j in near_pairs(sets):
        roots[top(i)] = top(j)
    roots = [top(i) for i in range(len(kept))]
    first = {}
    for (d, t), root in zip(kept, roots, strict=True):
        if root not in first or d < first[root][0]:
            first[root] = (d, t)
    anchors = {tuple(w[i : i + 5]) for _, x in items for w in [x.lower().split()] for i in range(len(w) - 4)}
    near = [(d, t) for d, t in first.values() if any(tuple(w[i : i + 5]) in anchors for w in [t.lower().split()] for i in range(len(w) - 4))]
    hit = {d for d, _ in slow(near, items)}
    want, encode = {}, Tokenizer.from_file(tokenizer_path())
    for d, t in first.values():
        if d in hit:
            continue
        at, out = 0, ""
        for s, _, _, e in slow_base(t):
            if s >= at or not at:
                out += t[at:s] + "[SECRET]"
            at = max(at, e)
        want[d] = len(encode.encode(out + t[at:], add_special_tokens=False).ids) + 1
    got = {}
    for r in corpus_pipeline.run(spark, SF).collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == want


def test_stages_on_edge_rows(spark):
    """Nulls, empty texts, repeated rows and clashing columns; an empty table."""
    docs, _ = edge_docs(spark)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == columns, name
        assert out.count() <= docs.count()
        assert stage(spark, no_docs(spark), SF).count() == 0
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, no_docs(spark), SF).count() == 0
    assert {r["doc_id"] for r in last(spark, docs, SF).collect()} == {r["doc_id"] for r in docs.collect()}


def test_whole_pipeline_on_edge_tables(spark, tmp_path):
    for name, docs in (("edges", edge_docs(spark)[0]), ("empty", no_docs(spark))):
        folder = tmp_path / name
        docs.write.parquet(f"{folder}/documents.parquet")
        for t in ("labels", "benchmark"):
            spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{folder}/{t}.parquet")
        rows = corpus_pipeline.run(spark, str(folder)).collect()
        assert bool(rows) == (name == "edges")

"""Benchmark passages in documents, by SimHash of item-sized windows.

A window has as many words as an item. Any window that is similar enough holds
most of the item's shingles, and sliding it on to its first such shingle loses
none of them; so only windows that start at a shared shingle (or end the text)
and hold enough of them are fingerprinted. Fingerprints are matched through
RADIUS + 1 blocks of bits: two within the radius agree on a whole block. Every
candidate is then compared by its weighted shingles.

RADIUS is where similarity 0.8 still lies with all but about one pair in ten
thousand at that very limit: such a pair differs in about 9.7 of 64 bits, with
a deviation of 2.9; closer pairs differ less.

Nulls and edges: a null text, or one without words, holds nothing; an item
without words is never found; items of under five words are one shingle of
their own length; a document shorter than an item is compared whole. Null
doc_ids and item_ids are kept, and rows with equal doc_id and item_id are
reported once. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import fresh, let, words

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 20
# Item rows sent to every task; above, both sides are shuffled.
SHIP_ROWS = 200_000


def _hashes(w: Column, size: Column | int) -> Column:
    """Hashes of all runs of `size` (1 to 5) words, with the size."""
    size = F.lit(size) if isinstance(size, int) else size
    heads = F.slice(w, F.lit(1), F.greatest(F.size(w) - size + 1, F.lit(0)))

    def run(x: Column, i: Column) -> Column:
        more = [F.when(size > k, F.get(w, i + k)) for k in range(1, SHINGLE)]
        return F.xxhash64(x, *more, size)

    return F.transform(heads, run)


def _five(w: Column) -> Column:
    """The same for runs of five, written without the cases."""
    heads = F.slice(w, F.lit(1), F.greatest(F.size(w) - F.lit(SHINGLE - 1), F.lit(0)))
    return F.transform(heads, lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, SHINGLE)], F.lit(SHINGLE)))


def _shingles(w: Column, size: int) -> Column:
    return _five(w) if size == SHINGLE else _hashes(w, size)


def simhash(hashes: Column) -> Column:
    """64 bits, each one if set in over half the hashes."""

    def bit(acc: Column, b: Column) -> Column:
        ones = F.aggregate(hashes, F.lit(0).cast("long"), lambda a, h: a + F.call_function("shiftrightunsigned", h, b).bitwiseAND(F.lit(1).cast("long")))
        return F.when(2 * ones > F.size(hashes), acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), b))).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), bit)


def _masks(radius: int) -> list[int]:
    """Bits of each of radius + 1 blocks, as signed longs."""
    edges = [64 * i // (radius + 1) for i in range(radius + 2)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _ship(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= SHIP_ROWS else df


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard: each shingle weighs as often as it stands there."""

    def shared(acc: Column, h: Column) -> Column:
        return acc + F.least(F.size(F.filter(a, lambda x: x == h)), F.size(F.filter(b, lambda x: x == h)))

    both = F.aggregate(F.array_distinct(b), F.lit(0), shared)
    return both.cast("double") / (F.size(a) + F.size(b) - both).cast("double")


def _keys(text: Column) -> list[Column]:
    """128 bits that stand for a text."""
    return [F.xxhash64(text, F.lit(1)).alias("k1"), F.xxhash64(text, F.lit(2)).alias("k2")]


def found_texts(texts: DataFrame, benchmark: DataFrame, least: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """(k1, k2, item_id, similarity, start_word) for a frame with one column
    `text`: the best window of each text for each item."""
    item_words = benchmark.select("item_id", words(F.lower("text")).alias("w")).filter(F.size("w") > 0)
    items = item_words.withColumn("len", F.size("w")).withColumn("size", F.least("len", F.lit(SHINGLE)))
    items = items.withColumn("item_hs", let(F.struct("w", "size"), lambda x: _hashes(x["w"], x["size"]))).drop("w")
    items = cut_lineage(items.withColumn("item_fp", let(F.col("item_hs"), simhash)))
    known = items.select("len", "size", F.explode("item_hs").alias("h")).distinct()
    n_items, n_known = items.count(), known.count()
    sizes = [r["size"] for r in items.select("size").distinct().collect()]  # one to five rows

    out = None
    for size in sizes:
        own = known.filter(F.col("size") == size).select("h", "len")
        words_of = F.transform(F.array(words(F.lower("text"))), lambda w: F.struct(F.size(w).alias("n"), _shingles(w, size).alias("hs")))
        rows = texts.select(*_keys(F.col("text")), F.inline(words_of)).filter(F.size("hs") > 0)
        placed = rows.select("k1", "k2", "n", F.posexplode("hs").alias("pos", "h"))
        # Copies of a text fold here.
        at = placed.join(_ship(own, n_known), "h").groupBy("k1", "k2", "n", "len").agg(F.sort_array(F.collect_set("pos")).alias("at"))
        held = F.col("len") - size + 1
        need = F.ceil(F.lit(least) * held - F.lit(1e-9)).cast("int")
        last = F.greatest(F.col("n") - F.col("len"), F.lit(0)).cast("int")
        full = F.filter("at", lambda p, i: (p < last) & (F.get(F.col("at"), i + need - 1) < p + held))
        tail = F.when(F.size(F.filter("at", lambda p: p >= last)) >= need, F.array(last)).otherwise(F.array().cast("array<int>"))
        starts = at.select("k1", "k2", "len", F.concat(full, tail).alias("starts")).filter(F.size("starts") > 0)
        starts = cut_lineage(starts.groupBy("k1", "k2").agg(F.collect_list(F.struct("len", "starts")).alias("asked")))
        once = rows.join(starts, ["k1", "k2"]).dropDuplicates(["k1", "k2"])
        windows = once.select("k1", "k2", "hs", F.explode("asked").alias("a")).select("k1", "k2", "hs", "a.len", F.explode("a.starts").alias("start"))
        windows = windows.select("k1", "k2", "len", "start", F.slice("hs", F.col("start") + 1, F.col("len") - size + 1).alias("hs"))
        windows = windows.withColumn("fp", let(F.col("hs"), simhash))
        hits = _candidates(windows, items.filter(F.col("size") == size), n_items, radius)
        hits = hits.withColumn("similarity", let(F.struct("hs", "item_hs"), lambda x: similarity(x["hs"], x["item_hs"]))).filter(F.col("similarity") >= least)
        hits = hits.select("k1", "k2", "item_id", "similarity", "start")
        out = hits if out is None else out.unionByName(hits)
    if out is None:
        return texts.sparkSession.createDataFrame([], f"k1 long, k2 long, item_id {benchmark.schema['item_id'].dataType.simpleString()}, similarity double, start_word long")
    best = F.max(F.struct("similarity", (-F.col("start")).alias("back")))
    found = out.groupBy("k1", "k2", "item_id").agg(best.alias("best"))
    return found.select("k1", "k2", "item_id", "best.similarity", (-F.col("best.back")).cast("long").alias("start_word"))


def _candidates(windows: DataFrame, items: DataFrame, n_items: int, radius: int) -> DataFrame:
    """Windows with the items of their length whose fingerprints lie within the
    radius. A pair that agrees on several blocks is kept at the first."""
    masks = _masks(radius)

    def blocks(fp: str) -> Column:
        each = [F.struct(F.lit(i).alias("block"), F.col(fp).bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(masks)]
        return F.explode(F.array(*each)).alias("b")

    left = windows.select("*", blocks("fp")).select(*windows.columns, "b.block", "b.bits")
    right = items.select("item_id", "len", "item_hs", "item_fp", blocks("item_fp")).select("item_id", "len", "item_hs", "item_fp", "b.block", "b.bits")
    met = left.join(_ship(right, n_items * (radius + 1)), ["len", "block", "bits"])
    differ = F.col("fp").bitwiseXOR(F.col("item_fp"))
    first = F.coalesce(*[F.when(differ.bitwiseAND(F.lit(m)) == 0, F.lit(i)) for i, m in enumerate(masks)])
    return met.filter((F.bit_count(differ) <= radius) & (F.col("block") == first))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and benchmark item that it holds."""
    text = F.coalesce("text", F.lit(""))
    found = found_texts(docs.select(text.alias("text")), benchmark)
    rows = docs.select("doc_id", *_keys(text)).join(found, ["k1", "k2"])
    best = rows.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start_word")).alias("back"))).alias("best"))
    return best.select("doc_id", "item_id", "best.similarity", (-F.col("best.back")).alias("start_word"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item."""
    text = F.coalesce("text", F.lit(""))
    k1, k2 = fresh(docs, "k1"), fresh(docs, "k2")
    hit = cut_lineage(found_texts(docs.select(text.alias("text")), benchmark).select(F.col("k1").alias(k1), F.col("k2").alias(k2)).distinct())
    a, b = _keys(text)
    return docs.withColumns({k1: a, k2: b}).join(hit, [k1, k2], "left_anti").select(*docs.columns)

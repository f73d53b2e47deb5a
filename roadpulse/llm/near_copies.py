"""Near copies by five-word shingles: every link is a measured similarity.

SimHash fingerprints of two texts with four fifths of their shingles in common
differ in some ten of 64 bits, far beyond what blocks of bits can filter. So
the fingerprints, under their generalised pigeonhole, are one source of
candidates, and bands of minimum hashes are the other; a pair is linked only if
the shares of common shingles, counted on the whole texts, reach `SIMILARITY`.

Texts with the same words are one entry first. In each bucket of entries the
smallest is the centre that all others are compared with. Those that are not
similar to it go on in smaller buckets, with twice as many minimum hashes in the
key each round, so a passage that many documents share does
not make all pairs of them, and a large group of near copies costs one comparison
each. The entries of
one centre are dealt to tasks in bounded numbers.

Nulls and edges: words and shingles are those of the fingerprint operator with
five words; a shorter text is one shingle, and all texts without words are equal.
Of each group the row with the smallest doc_id stays (a null one last; of equal
ids any one). An empty table stays empty. Extra columns are kept, whatever their
names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import fresh, small_batches
from .simhash_dedup import _LOWER, components, links

SIMILARITY = 0.8
SHINGLE = 5
# Minimum hashes of a text, and how many make a band.
HASHES, ROWS = 32, 4
# Entries compared with a centre in one group, about.
DEALT = 256
# A key with more than this share of a join's rows goes by broadcast.
COMMON = 1_000

_random = np.random.default_rng(20_240_229)
_ADD = _random.integers(0, 1 << 63, HASHES, np.uint64)
_TIMES = _random.integers(0, 1 << 62, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_LOWER).split()


def shingles(text: str | None) -> np.ndarray:
    """Hashes of the shingles of a text, each once, in order."""
    words = _words(text)
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) >= SHINGLE:
        starts, ends = starts[: 1 - SHINGLE], ends[SHINGLE - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts)))


def _sketch(text: str | None) -> tuple[bytes, int, np.ndarray]:
    """Key of the words, fingerprint, and minimum hashes."""
    key = xxhash.xxh3_128_digest(b" ".join(_words(text)))
    h = shingles(text)
    if not len(h):
        return key, 0, np.zeros(HASHES, np.int32)
    least = np.full(HASHES, ~np.uint64(0))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 4096):
        part = h[i : i + 4096]
        least = np.minimum(least, ((part ^ _ADD[:, None]) * _TIMES[:, None]).min(axis=1))
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    fp = int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])
    return key, fp, (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def sketch(text: Column) -> Column:
    """key, fp, sig of a text."""

    @F.pandas_udf("key binary, fp long, sig array<int>")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_sketch(t) for t in texts], columns=["key", "fp", "sig"])

    return run(text)


def met(rows: DataFrame, groups: DataFrame, on: str) -> DataFrame:
    """`rows` with what `groups` (`on`, `n` rows each, more) says of their group.
    Fewer than COMMON groups can each have more than that share of the grouped
    rows: these go by broadcast, and their rows stay out of the shuffle."""
    total = groups.agg(F.sum("n")).first()[0] or 0
    large = groups.filter(F.col("n") > F.lit(total / COMMON))
    names = [r[0] for r in large.select(on).collect()]  # fewer than COMMON
    if not names:
        return rows.join(groups, on)
    hot = F.col(on).isin(names)
    return rows.filter(~hot).join(groups, on).unionByName(rows.filter(hot).join(F.broadcast(large), on))


def similar(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (centre, key) whose texts (key, text) are similar enough."""
    sizes = pairs.groupBy("centre").agg(F.count("*").alias("n"))
    sizes = cut_lineage(sizes.withColumn("deals", F.ceil(F.col("n") / DEALT).cast("int")))
    dealt = met(pairs, sizes, "centre")
    dealt = dealt.withColumn("deal", F.pmod(F.xxhash64("key"), F.col("deals")).cast("int"))
    others = dealt.join(texts, "key").select("centre", "deal", "key", "text")
    heads = sizes.join(texts.withColumnRenamed("key", "centre"), "centre")
    heads = heads.select("centre", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"), F.lit(None).cast("binary").alias("key"), "text")

    def run(batches):
        at, held = None, None
        for pdf in batches:
            found = []
            for centre, deal, key, text in zip(pdf["centre"], pdf["deal"], pdf["key"], pdf["text"], strict=True):
                h = shingles(text)
                if key is None:  # the centre comes first
                    at, held = (centre, deal), h
                    continue
                assert at == (centre, deal)
                both = len(np.intersect1d(held, h, assume_unique=True))
                if both >= SIMILARITY * (len(held) + len(h) - both):
                    found.append((centre, key))
            yield pd.DataFrame(found, columns=["centre", "key"])

    small_batches(pairs.sparkSession)
    rows = heads.unionByName(others).repartition("centre", "deal").sortWithinPartitions("centre", "deal", "key")
    return rows.mapInPandas(run, "centre binary, key binary")


def linked_entries(entries: DataFrame, texts_of) -> DataFrame:
    """(centre, key) links among entries (key, fp, sig), one per text.
    `texts_of(keys)` gives their texts."""
    bands = [F.xxhash64(F.lit(j), F.slice("sig", ROWS * j + 1, ROWS)) for j in range(HASHES // ROWS)]
    numbers = [*range(len(bands)), -1]
    buckets = [F.struct(F.lit(j).alias("band"), c.alias("bucket")) for j, c in zip(numbers, [*bands, F.xxhash64(F.lit(-1), "fp")], strict=True)]
    keyed = cut_lineage(entries.select("key", "sig", F.explode(F.array(*buckets)).alias("b")).select("key", "sig", "b.*"))
    # One entry stands for a fingerprint where fingerprints are near each other.
    by_fp = cut_lineage(entries.groupBy("fp").agg(F.min("key").alias("key")))
    near = cut_lineage(links(by_fp.select("fp")))
    one, other = (by_fp.select(F.col("fp").alias(c), F.col("key").alias(k)) for c, k in (("a", "key"), ("b", "centre")))
    tried = near.join(one, "a").join(other, "b").select(F.least("centre", "key").alias("centre"), F.greatest("centre", "key").alias("key"))
    out, texts, used = None, None, ROWS
    while True:
        full = cut_lineage(keyed.groupBy("bucket").agg(F.min("key").alias("centre"), F.count("*").alias("n")).filter("n > 1"))
        tried_now = cut_lineage(met(keyed, full, "bucket").filter("key != centre").drop("n"))
        pairs = tried_now.select("centre", "key")
        pairs = cut_lineage((pairs.unionByName(tried) if out is None else pairs).distinct())
        if pairs.isEmpty():
            return out if out is not None else pairs
        if texts is None:
            # Later rounds compare some of these again.
            texts = cut_lineage(texts_of(pairs.select("key").union(pairs.select("centre")).distinct()))
        good = cut_lineage(similar(pairs, texts))
        out = good if out is None else out.unionByName(good)
        if used == HASHES:
            return out
        # What is left meets again where more minimum hashes agree.
        next_ = min(2 * used, HASHES)
        further = [F.expr(f"sig[pmod({ROWS} * band + {i}, {HASHES})]") for i in range(used, next_)]
        rest = tried_now.join(good, ["centre", "key"], "left_anti")
        keyed = cut_lineage(rest.select("key", "sig", "band", F.xxhash64("bucket", *further).alias("bucket")))
        used = next_


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The documents with one row of each group of near copies."""
    small_batches(docs.sparkSession)
    row, key, made = (fresh(docs, c) for c in ("row_number", "words_key", "sketch"))
    marked = docs.withColumn(row, F.monotonically_increasing_id()).withColumn(made, sketch(F.col("text")))
    marked = cut_lineage(marked.withColumn(key, F.col(made)["key"]))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(row).alias("row"))).alias("first")
    entries = marked.groupBy(F.col(key).alias("key")).agg(F.min(F.col(made)["fp"]).alias("fp"), F.min(F.col(made)["sig"]).alias("sig"), first)
    entries = cut_lineage(entries)

    def texts_of(keys: DataFrame) -> DataFrame:
        rows = entries.join(keys, "key", "left_semi").select("key", F.col("first.row").alias(row))
        return marked.select(row, "text").join(rows, row).select("key", "text")

    pairs = linked_entries(entries.select("key", "fp", "sig"), texts_of)
    groups = components(pairs.select(F.col("centre").alias("a"), F.col("key").alias("b")))
    named = entries.join(groups.withColumnRenamed("node", "key"), "key", "left")
    kept = named.groupBy(F.coalesce("root", "key")).agg(F.min("first")["row"].alias(row)).select(row)
    return marked.join(kept.hint("shuffle_hash"), row, "left_semi").select(*docs.columns)

"""Near-duplicate documents by SimHash under a generalised pigeonhole.

Two fingerprints that differ in at most `radius` bits must, for any split of
the bits into m parts with thresholds that add up to radius - m + 1, differ in
at most the threshold of one part. Correlated bits share a part, and the
thresholds come from a dynamic program over estimated costs: they steer the
work only, never the links found.

Nulls and edges: a null or empty text has fingerprint zero and links like any
other. A null doc_id takes part in links but is never a component's name; where
a component holds null ids only, its name is null. Repeated rows stay. An empty
table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import fresh, small_batches

RADIUS = 3
SHINGLE = 3
SEED = 42
# Fingerprints compared in one group at most: two blocks of this size.
BLOCK = 1024
# Fingerprints from which bit correlations and costs are estimated.
SAMPLE = 20_000
# Cost of comparing a candidate pair, relative to shuffling one key.
PAIR_COST = 0.02

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None) -> int:
    """The unsigned fingerprint of one text."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    if len(words) >= SHINGLE:
        starts, ends = starts[: 1 - SHINGLE], ends[SHINGLE - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for i in range(0, len(starts), 1 << 16):
        spans = zip(starts[i : i + (1 << 16)].tolist(), ends[i : i + (1 << 16)].tolist(), strict=True)
        h = np.array([digest(joined[s:e], SEED) for s, e in spans], "<u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def fingerprint_column(text: Column) -> Column:
    """The fingerprint as a signed long."""

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        found = np.fromiter(map(fingerprint, texts), np.uint64, len(texts))
        return pd.Series(found.view(np.int64))

    return run(text)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", fingerprint_column(F.col("text")).alias("fp"))


# --- parts and thresholds ---


def correlated_parts(sample: np.ndarray, m: int) -> list[list[int]]:
    """64 bits in m parts of nearly equal width; bits that go together share one."""
    bits = np.unpackbits(sample.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    centred = bits - bits.mean(axis=0) if len(sample) else np.zeros((1, 64))
    norm = np.sqrt((centred**2).sum(axis=0))
    strength = np.abs(centred.T @ centred) / np.maximum(np.outer(norm, norm), 1e-9)
    left, parts = set(range(64)), []
    for i in range(m):
        width = len(left) // (m - i)
        pool = sorted(left)
        part = [max(pool, key=lambda b: strength[b, pool].sum())]
        while len(part) < width:
            rest = sorted(left.difference(part))
            part.append(max(rest, key=lambda b: strength[b, part].sum()))
        left.difference_update(part)
        parts.append(sorted(part))
    return parts


def _mask(part: list[int]) -> int:
    return sum(1 << b for b in part)


def _pairs_within(sample: np.ndarray, part: list[int], t: int, n: int) -> float:
    """Expected pairs of n fingerprints whose keys for this part meet."""
    if t < 0:
        return 0.0
    values, counts = np.unique(sample & np.uint64(_mask(part)), return_counts=True)
    met = (counts * (counts - 1) / 2).sum()
    if t == 1:
        for b in part:
            at = np.minimum(np.searchsorted(values, values ^ np.uint64(1 << b)), len(values) - 1)
            met += (counts * counts[at] * (values[at] == values ^ np.uint64(1 << b))).sum() / 2
    pairs = max(len(sample) * (len(sample) - 1) / 2, 1)
    uniform = (1 + t * len(part)) / 2.0 ** len(part)
    return max(met / pairs, uniform) * n * n / 2


def allocate(sample: np.ndarray, n: int, radius: int = RADIUS) -> list[tuple[list[int], int]]:
    """The cheapest parts with their thresholds (-1: not probed, 0, 1)."""
    best: tuple[float, list] = (float("inf"), [])
    for m in range(radius // 2 + 1, radius + 2):
        need = radius - m + 1
        # by the sum of thresholds so far: cost and choices
        table: dict[int, tuple[float, list]] = {0: (0.0, [])}
        for part in correlated_parts(sample, m):
            costs = {t: (0 if t < 0 else n * (1 + t * len(part) / 2)) + PAIR_COST * _pairs_within(sample, part, t, n) for t in (-1, 0, 1)}
            step: dict[int, tuple[float, list]] = {}
            for total, (cost, chosen) in table.items():
                for t, more in costs.items():
                    new = (cost + more, [*chosen, (part, t)])
                    if total + t not in step or new[0] < step[total + t][0]:
                        step[total + t] = new
            table = step
        if need in table and table[need][0] < best[0]:
            best = table[need]
    return [(p, t) for p, t in best[1] if t >= 0]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _keys(fp: Column, plan: list[tuple[list[int], int]]) -> Column:
    """All keys of a fingerprint. At threshold one the keys with one more bit
    set are added: of two keys that differ in one bit, one meets the other."""

    def of(i: int, part: list[int], t: int) -> Column:
        own = fp.bitwiseAND(F.lit(_signed(_mask(part))))

        def key(k: Column) -> Column:
            return F.struct(F.lit(i).alias("part"), k.alias("key"))

        if t == 0:
            return F.array(key(own))
        bits = F.array(*[F.lit(_signed(1 << b)) for b in part])
        unset = F.filter(bits, lambda b: own.bitwiseAND(b) == F.lit(0))
        return F.concat(F.array(key(own)), F.transform(unset, lambda b: key(own.bitwiseOR(b))))

    return F.concat(*[of(i, part, t) for i, (part, t) in enumerate(plan)])


# --- links ---


def _forest(u: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """(fingerprint, smallest of its group) for the groups linked within u."""
    near = np.bitwise_count(u[:, None] ^ u[None, :]) <= radius
    open_, edges = near.sum(axis=1) > 1, []
    for i in np.flatnonzero(open_):
        if not open_[i]:
            continue
        group = np.zeros(len(u), bool)
        front = np.array([i])
        while len(front):
            group[front] = True
            front = np.flatnonzero(near[front].any(axis=0) & ~group)
        open_ &= ~group
        members = np.sort(u[group].view(np.int64))
        edges += [(int(v), int(members[0])) for v in members[1:]]
    return edges


def _verify(radius: int):
    def run(batches):
        for pdf in batches:
            edges = []
            sizes = pdf["fps"].map(len).to_numpy() if len(pdf) else np.zeros(0, int)
            for size in np.unique(sizes):
                rows = pdf["fps"][sizes == size]
                step = max(1, (1 << 20) // int(size) ** 2)
                for i in range(0, len(rows), step):
                    u = np.stack(rows.iloc[i : i + step].to_list()).astype(np.int64).view(np.uint64)
                    if step == 1:
                        edges += _forest(u[0], radius)
                        continue
                    near = np.bitwise_count(u[:, :, None] ^ u[:, None, :]) <= radius
                    for row in u[near.sum(axis=(1, 2)) > size]:
                        edges += _forest(row, radius)
            yield pd.DataFrame(np.array(edges, np.int64).reshape(-1, 2), columns=["a", "b"])

    return run


def links(distinct: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Pairs (a, b) of fingerprints that connect all within `radius` of each
    other: of each group of fingerprints that share a key, a spanning forest of
    its true links. Buckets above `block` are compared block by block."""
    n = distinct.count()
    share = min(1.0, SAMPLE / max(n, 1))
    picked = distinct.filter(F.pmod(F.xxhash64("fp"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))).limit(2 * SAMPLE)
    sample = picked.toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    plan = allocate(sample, n, radius)
    keyed = distinct.select("fp", F.explode(_keys(F.col("fp"), plan)).alias("k")).select("fp", "k.part", "k.key")
    hot = keyed.groupBy("part", "key").count().filter(F.col("count") > block)
    hot = hot.select("part", "key", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    dealt = keyed.join(hot, ["part", "key"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("fp", F.lit(1)), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = dealt.groupBy("part", "key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi")).agg(F.collect_list("fp").alias("fps"))
    tiles = tiles.filter(F.size("fps") > 1).select("fps")
    return tiles.mapInPandas(_verify(radius), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge; root is the smallest node
    reachable. Alternates large and small stars, each round kept as a table."""

    def stars(e: DataFrame) -> DataFrame:
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.filter("a <> b").distinct()
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        joined = down.join(low, "a")
        small = joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return small.union(low.select("a", F.col("m").alias("b"))).distinct()

    def state(e: DataFrame):
        sums = [F.sum(F.pmod(F.xxhash64("a", "b", F.lit(s)), F.lit(1 << 30))) for s in (1, 2)]
        return e.agg(F.count("*"), *sums).first()

    edges = cut_lineage(edges.filter("a <> b").distinct())
    before = state(edges)
    while before[0]:
        edges = cut_lineage(stars(edges))
        after = state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())


def linked(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, root, component_id, first_fp) per distinct fingerprint: the smallest
    doc_id of its component, and the fingerprint of a row that has it."""
    reps = cut_lineage(fps.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    roots = components(links(reps.select("fp"), radius)).select(F.col("node").alias("fp"), "root")
    joined = reps.join(roots, "fp")
    first = F.struct(F.coalesce(F.col("least_id"), F.lit((1 << 63) - 1)), F.col("fp"))
    names = joined.groupBy("root").agg(F.min("least_id").alias("component_id"), F.min(first)["fp"].alias("first_fp"))
    named = joined.select("fp", "root").join(names, "root")
    return reps.join(named, "fp", "left").select(
        "fp",
        F.coalesce("root", "fp").alias("root"),
        F.when(F.col("root").isNull(), F.col("least_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("first_fp", "fp").alias("first_fp"),
    )


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row per document: doc_id, fingerprint (hex), component_id."""
    fps = cut_lineage(fingerprints(docs))
    found = fps.join(linked(fps, radius).select("fp", "component_id"), "fp")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The documents with one row of each component: that of the smallest
    doc_id (any row without one, where the component has none)."""
    small_batches(docs.sparkSession)
    fps = cut_lineage(fingerprints(docs))
    keep = linked(fps, radius).filter(F.col("fp") == F.col("first_fp"))
    # Keyed by fingerprint and id, so that copies do not meet in one task.
    fp, key, none = (fresh(docs, c) for c in ("fp", "id_or_zero", "no_id"))

    def by_row(df: DataFrame, id_: str) -> DataFrame:
        return df.withColumns({key: F.coalesce(id_, F.lit(0)), none: F.col(id_).isNull()})

    keep = by_row(keep.withColumnRenamed("fp", fp), "component_id").select(fp, key, none)
    marked = by_row(docs.withColumn(fp, fingerprint_column(F.col("text"))), "doc_id")
    kept = marked.join(keep.hint("merge"), [fp, key, none])
    return kept.dropDuplicates([fp, key, none]).select(*docs.columns)

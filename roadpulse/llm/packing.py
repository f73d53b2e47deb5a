"""Pack documents into as few token sequences as can be, by bin completion.

Pieces matter by length only, and lengths are at most the capacity, so the
search runs on the counts per length: a table of bounded size whatever the
data. It starts from best-fit decreasing; where that is above the lower bound,
a branch-and-bound fills bins around the largest piece left with fillings that
no other filling dominates, and leaves a branch once its waste cannot beat the
best packing known. The pieces then find their places by rank within length.

Nulls and edges: a null or empty text is the end id alone; null and repeated
doc_ids keep a row per piece of each row; an empty table gives no rows. Other
columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import small_batches
from .tokens import encoder, gathered, tokenizer_path

CAPACITY = 2048
END_ID = 0
# Nodes of the search; the best packing found by then is used.
NODES = 20_000
# Fillings tried at a node.
WIDTH = 6
# Pieces of one length ranked in one task, about.
RANKED = 2_000

# (times, lengths): a filling, and how many bins get it.
Filling = tuple[int, tuple[int, ...]]


# --- the plan over counts per length ---


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Bins that any packing needs: the sum of lengths, and for each threshold
    pieces above half the bin with what cannot go beside them."""
    best = -(-sum(n * c for n, c in counts.items()) // capacity)
    for k in {0, *(n for n in counts if 2 * n <= capacity)}:
        large = sum(c for n, c in counts.items() if n > capacity - k)
        middle = [(n, c) for n, c in counts.items() if capacity - k >= n and 2 * n > capacity]
        small = sum(n * c for n, c in counts.items() if k <= n and 2 * n <= capacity)
        room = sum((capacity - n) * c for n, c in middle)
        best = max(best, large + sum(c for _, c in middle) + max(0, -(-(small - room) // capacity)))
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[Filling]:
    """Best-fit decreasing, whole runs of equal pieces and equal bins at a time."""
    open_: dict[int, dict[tuple[int, ...], int]] = {}
    for n in sorted(counts, reverse=True):
        left = counts[n]
        rooms = sorted(r for r in open_ if r >= n)
        while left:
            i = bisect_left(rooms, n)
            if i == len(rooms):
                each = capacity // n
                full, rest = divmod(left, each)
                for k, times in ((each, full), (rest, 1)):
                    if k and times:
                        bins = open_.setdefault(capacity - k * n, {})
                        bins[(n,) * k] = bins.get((n,) * k, 0) + times
                break
            room = rooms[i]
            filling, times = next(iter(open_[room].items()))
            used = min(left, times)
            if used == times:
                del open_[room][filling]
            else:
                open_[room][filling] = times - used
            if not open_[room]:
                del open_[room]
                rooms.pop(i)
            to = room - n
            bins = open_.setdefault(to, {})
            bins[(*filling, n)] = bins.get((*filling, n), 0) + used
            if to >= n and (j := bisect_left(rooms, to)) in range(len(rooms) + 1) and (j == len(rooms) or rooms[j] != to):
                rooms.insert(j, to)
            left -= used
    return [(times, f) for bins in open_.values() for f, times in bins.items()]


def fillings(lengths: list[int], counts: dict[int, int], room: int, width: int) -> list[tuple[int, ...]]:
    """Undominated sets of up to three pieces for a room, the fullest first. A
    set is left out where one with fewer, larger pieces fills as much."""

    def largest(limit: int, used: tuple[int, ...]) -> int | None:
        i = bisect_right(lengths, limit) - 1
        while i >= 0 and counts[lengths[i]] <= used.count(lengths[i]):
            i -= 1
        return lengths[i] if i >= 0 else None

    one = largest(room, ())
    if one is None:
        return [()]
    found = {(one,): one}
    best_one = one
    firsts = [n for n in lengths if n <= room][::-1][: 8 * width]
    for a in firsts:
        b = largest(min(a, room - a), (a,))
        if b is None:
            continue
        if a + b > best_one:
            found[(a, b)] = a + b
        for b2 in [x for x in lengths[max(0, bisect_right(lengths, min(a, room - a)) - width) : bisect_right(lengths, min(a, room - a))]]:
            if counts[b2] <= (a,).count(b2):
                continue
            c = largest(min(b2, room - a - b2), (a, b2))
            if c is not None and a + b2 + c > a + b:
                found[(a, b2, c)] = a + b2 + c
    ranked = sorted(found, key=lambda f: (-found[f], len(f), tuple(-x for x in f)))
    return ranked[:width]


def complete(counts: dict[int, int], capacity: int, bins: int, nodes: int) -> list[Filling] | None:
    """A packing into fewer than `bins` bins, or None if none was found."""
    total = sum(n * c for n, c in counts.items())
    allowed = (bins - 1) * capacity - total
    if allowed < 0:
        return None
    # Depth first, on a stack of its own: counts left, waste so far, choices.
    stack: list[tuple[dict[int, int], int, list[Filling]]] = [(dict(counts), 0, [])]
    while stack and nodes:
        nodes -= 1
        left, waste, chosen = stack.pop()
        if not left:
            return chosen
        lengths = sorted(left)
        top = lengths[-1]
        rest = {**left, top: left[top] - 1}
        branches = []
        for f in fillings(lengths, rest, capacity - top, WIDTH):
            full = list(f)
            # Room that three pieces leave is filled greedily.
            room = capacity - top - sum(full)
            for n in reversed(lengths[: bisect_right(lengths, room)]):
                while n <= room and rest[n] > full.count(n):
                    full.append(n)
                    room -= n
            bin_ = (top, *full)
            times = min(left[n] // bin_.count(n) for n in set(bin_))
            if waste + room * times > allowed:
                times = (allowed - waste) // room if room else times
            if times:
                after = {n: c for n, c in ((n, c - times * bin_.count(n)) for n, c in left.items()) if c}
                branches.append((room, after, waste + room * times, [*chosen, (times, bin_)]))
        for room, after, lost, choice in sorted(branches, key=lambda b: -b[0]):
            stack.append((after, lost, choice))
    return None


def plan(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> list[Filling]:
    """Fillings that take every piece of these counts exactly once."""
    best = best_fit(counts, capacity)
    bound = lower_bound(counts, capacity)
    while (bins := sum(t for t, _ in best)) > bound and (better := complete(counts, capacity, bins, nodes)) is not None:
        best = better
    return best


# --- the job ---


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        enc = encoder(path)
        for batch in gathered(batches):
            ids, ends = enc.encode_all(batch.column("text"))
            sizes = np.diff(ends, prepend=0) + 1
            # A row per piece: its document, its place there, its ids.
            n = -(-sizes // capacity)
            doc = np.repeat(np.arange(len(n)), n)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * capacity
            length = np.minimum(sizes[doc] - start, capacity)
            last = piece == n[doc] - 1
            at = (ends - sizes + 1)[doc] + start
            data = memoryview(ids.astype("<u4", copy=False).view(np.uint8))
            crcs = [zlib.crc32(end, c) if z else c for c, z in zip(map(zlib.crc32, (data[4 * a : 4 * b] for a, b in zip(at.tolist(), (at + length - last).tolist(), strict=True))), last.tolist(), strict=True)]
            columns = [batch.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crcs, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def places(counts: dict[int, int], capacity: int) -> dict[int, tuple[np.ndarray, ...]]:
    """Per length, by rank: first rank of a run, its first sequence, pieces per
    sequence, and their offset."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for times, filling in plan(counts, capacity):
        offset = 0
        for n in sorted(set(filling), reverse=True):
            k = filling.count(n)
            runs.setdefault(n, []).append((taken.get(n, 0), sequence, k, offset))
            taken[n] = taken.get(n, 0) + times * k
            offset += k * n
        sequence += times
    return {n: tuple(np.array(x, np.int64) for x in zip(*r, strict=True)) for n, r in runs.items()}


def ranked(found: DataFrame, n: int) -> DataFrame:
    """`found` with the rank of each piece within its length. Each length is
    ranked in salted parts, so that a common length is no single group."""
    salts = max(64, n // RANKED)
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    rows = salted.withColumn("rank", F.row_number().over(own) - F.lit(1))
    return rows.join(first, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("first")).drop("salt", "first")


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece with its sequence_id and offset."""
    found = cut_lineage(pieces(docs, path or tokenizer_path(), capacity))
    # at most one row per length
    counts = {r["length"]: r["count"] for r in found.groupBy("length").count().collect()}
    table = places(counts, capacity)

    def place(batches):
        for pdf in batches:
            length, rank = pdf["length"].to_numpy(), pdf.pop("rank").to_numpy()
            sequence, offset = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                first, base, each, start = table[int(n)]
                run = np.searchsorted(first, rank[at], side="right") - 1
                i = rank[at] - first[run]
                sequence[at] = base[run] + i // each[run]
                offset[at] = start[run] + i % each[run] * n
            yield pdf.assign(sequence_id=sequence, offset=offset, doc_id=pdf["doc_id"].astype("Int64"))

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    rows = ranked(found, sum(counts.values())).select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return rows.mapInPandas(place, schema)

"""Prefix trie of conversations, from double-array tries per prefix shard.

Rebuilt conversations are cut into segments of `SEGMENT` turns, each under the
hash of all turns before it, so a conversation of any length spreads. Equal
segments under one prefix fold to a row with the number of their conversations
and the smallest conv_id. A shard is what follows one prefix; a prefix that too
many rows follow is no shard, its continuations at twice the depth are. A task
packs the shards that it holds into one BASE and one CHECK array over dense
numbers of the turns, walks all rows through them, and reads off its nodes, whose
figures are final. Nodes above the shards are shared by several: their figures
are merged by key, and what lies below them is summed along parents that double
their reach each round, so a tree of depth d takes log2(d) rounds.

A node's key is the exclusive or of two 64-bit hashes of each (place, role,
text) up to it. Joins on keys that many rows may share send the few keys above a
thousandth of the rows by broadcast.

Nulls and edges: a null role or text is empty; null turns come first, turns with
equal numbers are ordered by the hash of role and text, and repeated rows all
count; rows without a conv_id belong to no conversation and are left out; an
empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

SEGMENT = 64
# Rows of a shard at most, or this part of all rows if that is more.
SHARD_ROWS, SHARD_PART = 2_000, 100_000
# Rows packed into one pair of arrays, about.
PACKED_ROWS = 5_000
# A key with more than this share of a join's rows goes by broadcast.
COMMON = 1_000
# conv_ids joined into one text before they are hashed.
JOINED = 512
# Segments of a conversation whose running keys one window gives.
BLOCK = 1024

KEY = ["ka", "kb"]


def spread_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join with a right side of one row per key, where many rows of the left
    may share a key. Both sides are read twice: hand in written tables."""
    n = left.count()
    common = left.groupBy(*on).count().filter(F.col("count") > F.lit(n / COMMON)).select(*on)
    common = F.broadcast(cut_lineage(common))  # fewer than COMMON rows
    few = F.broadcast(right.join(common, on, "left_semi"))
    out = left.join(common, on, "left_semi").join(few, on, how)
    return out.unionByName(left.join(common, on, "left_anti").join(right, on, how))


# --- rebuilt conversations ---


def _placed(turns: DataFrame) -> DataFrame:
    """conv_id, part, place, ha, hb, chars: places count within (conv_id, part),
    parts being ranges of the sorted turns."""
    said = turns.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    rows = said.select("conv_id", "turn", F.xxhash64("role", "text").alias("ha"), F.xxhash64("text", "role", F.lit(1)).alias("hb"), F.length("text").cast("long").alias("chars"))
    # Rows that agree in all are told apart only to spread them.
    order = ["conv_id", "turn", "ha", "hb", "row"]
    ranged = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*order)
    ranged = cut_lineage(ranged.withColumn("part", F.spark_partition_id()))
    own = Window.partitionBy("conv_id", "part").orderBy("turn", "ha", "hb", "row")
    return ranged.select("conv_id", "part", F.row_number().over(own).cast("long").alias("place"), "ha", "hb", "chars")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations (conv_id, n_turns) and their turns (conv_id, n_turns,
    at from 1, ha, hb, chars), each with the head of its hundred's first."""
    rows = cut_lineage(_placed(turns))
    parts = rows.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = cut_lineage(parts.withColumn("n_before", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long"))))
    sizes = parts.groupBy("conv_id").agg(F.sum("n").alias("n"))
    head = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(6))
    convs = sizes.withColumns({"h": head, "base": F.col("conv_id") - F.col("conv_id") % F.lit(100)})
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    convs = convs.join(bases, "base", "left").withColumn("lent", F.least("h", F.coalesce("n_base", F.lit(0).cast("long"))))
    convs = cut_lineage(convs.withColumn("n_turns", F.col("lent") + F.greatest(F.col("n") - F.col("h"), F.lit(0))))
    # One row per conversation and range, so a long conversation is no one key.
    at_parts = parts.select("conv_id", "part", "n_before").join(convs.select("conv_id", "h", "lent", "n_turns"), "conv_id")
    own = rows.join(at_parts, ["conv_id", "part"]).withColumn("place", F.col("place") + F.col("n_before"))
    later = own.filter("place > h").select("conv_id", "n_turns", (F.col("lent") + F.col("place") - F.col("h")).alias("at"), "ha", "hb", "chars")
    first = own.filter("place <= 5 and conv_id % 100 = 0").groupBy(F.col("conv_id").alias("base"))
    heads = first.agg(F.sort_array(F.collect_list(F.struct("place", "ha", "hb", "chars"))).alias("head"))
    lent = convs.filter("lent > 0").join(heads, "base")
    lent = lent.select("conv_id", "n_turns", F.explode(F.expr("slice(head, 1, cast(lent as int))")).alias("t"))
    lent = lent.select("conv_id", "n_turns", F.col("t.place").alias("at"), "t.ha", "t.hb", "t.chars")
    return convs.select("conv_id", "n_turns"), later.unionByName(lent)


def _xor(turns: str, which: str, n: str = "") -> str:
    part = f"slice({turns}, 1, {n})" if n else turns
    return f"aggregate({part}, 0L, (a, t) -> a ^ t.{which})"


def segments(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """Per conversation and segment: conv_id, seg, ka, kb (the key of what comes
    before), goes_on, turns."""
    keyed = turns.select(
        "conv_id",
        "n_turns",
        F.floor((F.col("at") - 1) / SEGMENT).alias("seg"),
        F.struct("at", F.xxhash64("at", "ha", "hb").alias("xa"), F.xxhash64("at", "hb", "ha").alias("xb"), "chars").alias("t"),
    )
    # at most SEGMENT turns in a list
    cut = keyed.groupBy("conv_id", "n_turns", "seg").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    cut = cut_lineage(cut.withColumn("goes_on", F.col("n_turns") > (F.col("seg") + 1) * SEGMENT))
    zero = F.lit(0).cast("long")
    short = cut.filter(F.col("n_turns") <= SEGMENT).withColumns({"ka": zero, "kb": zero})
    long = cut.filter(F.col("n_turns") > SEGMENT).withColumn("block", F.floor(F.col("seg") / BLOCK))
    long = long.withColumns({x: F.expr(_xor("turns", x)) for x in ("xa", "xb")})
    # Running keys within blocks of segments, and over the blocks before.
    whole = long.groupBy("conv_id", "block").agg(F.bit_xor("xa").alias("ya"), F.bit_xor("xb").alias("yb"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select("conv_id", "block", *[F.coalesce(F.bit_xor(y).over(earlier), zero).alias(y) for y in ("ya", "yb")])
    inside = Window.partitionBy("conv_id", "block").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    long = long.join(whole, ["conv_id", "block"])
    for k, x, y in (("ka", "xa", "ya"), ("kb", "xb", "yb")):
        long = long.withColumn(k, F.coalesce(F.bit_xor(x).over(inside), zero).bitwiseXOR(F.col(y)))
    columns = ["conv_id", "seg", *KEY, "goes_on", "turns"]
    empty = convs.filter("n_turns = 0").select("conv_id", zero.alias("seg"), zero.alias("ka"), zero.alias("kb"), F.lit(False).alias("goes_on"))
    empty = empty.withColumn("turns", F.expr("slice(array(struct(0L as at, 0L as xa, 0L as xb, 0L as chars)), 1, 0)"))
    return short.select(*columns).unionByName(long.select(*columns)).unionByName(empty.select(*columns))


# --- shards ---


def shard(rows: DataFrame, shard_rows: int | None = None) -> DataFrame:
    """`rows` with `cut`, the depth in the segment at which its shard begins, and
    the shard's key sa, sb. Where all beginnings of a row are too common, `cut`
    lies beyond its end: it has no node in a shard."""
    n = rows.count()
    most = shard_rows or max(SHARD_ROWS, n // SHARD_PART)
    depths = [1 << i for i in range(SEGMENT.bit_length())]
    at = F.explode(F.array(*[F.when(F.size("turns") >= d, F.struct(F.lit(d).alias("d"), *_keys(str(d)))) for d in depths])).alias("p")
    counts = rows.select(at).filter("p is not null").select("p.*").groupBy("d", "sa", "sb").agg(F.count("*").alias("n"))
    # at most 7 * SHARD_PART rows, whatever the table
    big = cut_lineage(counts.filter(F.col("n") > F.lit(most)).select("d", "sa", "sb"))
    out = rows.withColumn("big", F.lit(0))
    for d in sorted(r["d"] for r in big.select("d").distinct().collect()):
        here = F.broadcast(big.filter(F.col("d") == d).select("sa", "sb", F.lit(d).alias("is_big")))
        keyed = out.withColumns({k: F.when(F.size("turns") >= d, c) for k, c in zip(("sa", "sb"), _keys(str(d)), strict=True)})
        out = keyed.join(here, ["sa", "sb"], "left").withColumn("big", F.coalesce("is_big", "big")).drop("is_big", "sa", "sb")
    cut = F.when(F.col("big") == 0, F.lit(1)).otherwise(2 * F.col("big"))
    out = out.withColumn("cut", F.least(cut, F.size("turns") + 1)).drop("big")
    return out.withColumns(dict(zip(("sa", "sb"), _keys("cut"), strict=True)))


def _keys(n: str) -> list[Column]:
    return [F.expr(f"{k} ^ {_xor('turns', x, n)}").alias(s) for s, k, x in (("sa", "ka", "xa"), ("sb", "kb", "xb"))]


# --- one pair of arrays ---


class DoubleArray:
    """BASE and CHECK over states: the child of s by code c is t = BASE[s] + c,
    if CHECK[t] = s. State 0 is the root. BASE may be negative."""

    def __init__(self):
        self.base = np.zeros(64, np.int64)
        self.check = np.full(64, -1, np.int64)
        self.check[0] = 0
        self.free = 1  # no free state lies before this one

    def _grow(self, size: int) -> None:
        if size > len(self.check):
            more = max(size, 2 * len(self.check)) - len(self.check)
            self.base = np.concatenate([self.base, np.zeros(more, np.int64)])
            self.check = np.concatenate([self.check, np.full(more, -1, np.int64)])

    def add(self, s: int, codes: list[int]) -> None:
        """Give a state without children these children, codes ascending."""
        check = self.check
        while self.free < len(check) and check[self.free] >= 0:
            self.free += 1
        at, first = self.free, codes[0]
        while True:
            span = at - first + codes[-1]
            self._grow(max(span, at) + 1)
            check = self.check
            if check[at] < 0 and all(check[at - first + c] < 0 for c in codes[1:]):
                break
            at += 1
        self.base[s] = at - first
        for c in codes:
            check[at - first + c] = s

    def step(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The children of these states by these codes, -1 where there is none."""
        to = self.base[states] + codes
        inside = (to > 0) & (to < len(self.check))
        return np.where(inside & (self.check[np.where(inside, to, 0)] == states), to, -1)


def _codes(states: np.ndarray, symbols: np.ndarray, first: int) -> tuple[np.ndarray, int]:
    """Dense numbers of the symbols from `first`, those under one state together."""
    order = np.lexsort((symbols, states))
    values, begin, inverse = np.unique(symbols[order], return_index=True, return_inverse=True)
    number = np.empty(len(values), np.int64)
    number[np.argsort(begin, kind="stable")] = np.arange(len(values))
    out = np.empty(len(symbols), np.int64)
    out[order] = number[inverse]
    return out + first, first + len(values)


def _spread(trie: DoubleArray, states: np.ndarray, codes: np.ndarray) -> None:
    """Add the children that (state, code) pairs name."""
    pairs = np.unique(np.stack([states, codes], 1), axis=0)
    starts = np.flatnonzero(np.diff(pairs[:, 0], prepend=-1))
    children = pairs[:, 1].tolist()
    for s, a, b in zip(pairs[starts, 0].tolist(), starts.tolist(), [*starts[1:].tolist(), len(pairs)], strict=True):
        trie.add(s, children[a:b])


NODE = (
    "upper boolean, top boolean, ka long, kb long, pa long, pb long, depth long, conv long, parent_conv long,"
    " n long, going long, chars long, children long, leaves long, saved long, path array<struct<ka: long, kb: long>>"
)
COLUMNS = [*(c.split()[0] for c in NODE.split(", path")[0].split(",")), "path"]


def _nodes(f: dict) -> pd.DataFrame:
    """The nodes of the shards packed here, and per shard a row for each node
    above it. `f` holds per row: shard, ka, kb, seg, cut, n, conv, going, size,
    and the flat turns xa, xb, chars with their row's first index."""
    rows, size, cut = len(f["n"]), f["size"], f["cut"]
    depth_max = int(size.max(initial=0))
    trie, out = DoubleArray(), []
    # The key of every row at every depth, and the length of the text there.
    ka, kb = np.zeros((depth_max + 1, rows), np.int64), np.zeros((depth_max + 1, rows), np.int64)
    chars, xa = np.zeros((depth_max + 1, rows), np.int64), np.zeros((depth_max + 1, rows), np.int64)
    ka[0], kb[0] = f["ka"], f["kb"]
    for d in range(1, depth_max + 1):
        has = size >= d
        i = np.where(has, f["first"] + d - 1, 0)
        xa[d], chars[d] = np.where(has, f["xa"][i], 0), np.where(has, f["chars"][i], 0)
        ka[d], kb[d] = ka[d - 1] ^ xa[d], kb[d - 1] ^ np.where(has, f["xb"][i], 0)

    # Above the shards: one row per shard and depth.
    lead = np.unique(f["shard"], return_index=True)[1]
    shards = len(lead)
    n_all = np.zeros(shards, np.int64)
    conv_all = np.full(shards, np.iinfo(np.int64).max)
    np.add.at(n_all, f["shard"], f["n"])
    np.minimum.at(conv_all, f["shard"], f["conv"])
    for d in range(depth_max + 1):
        # The node before a later segment is counted in the segment it ends.
        on = (cut[lead] > d) & (size[lead] >= d) & ((d > 0) | (f["seg"][lead] == 0))
        r = lead[on]
        if not len(r):
            continue
        before = max(d - 1, 0)
        out.append(
            {
                "upper": True, "top": False, "ka": ka[d][r], "kb": kb[d][r], "pa": ka[before][r], "pb": kb[before][r],
                "depth": f["seg"][r] * SEGMENT + d, "conv": conv_all[on], "parent_conv": 0, "n": n_all[on], "going": 0, "chars": chars[d][r], "children": 0, "leaves": 0, "saved": 0, "path": None,
            }
        )

    # Shard tops hang on the root; below, a level of all shards at a time.
    state = np.full(rows, -1, np.int64)
    inside = size >= cut
    levels, codes_used = [], 0
    if inside.any():
        at = np.flatnonzero(inside)
        codes = f["shard"][at]
        codes_used = int(codes.max()) + 1
        _spread(trie, np.zeros(len(at), np.int64), codes)
        state[at] = trie.step(np.zeros(len(at), np.int64), codes)
        levels.append((at, cut[at]))
        step = 0
        while True:
            step += 1
            at = np.flatnonzero(inside & (size >= cut + step))
            if not len(at):
                break
            depth = cut[at] + step
            codes, codes_used = _codes(state[at], xa[depth, at], codes_used)
            _spread(trie, state[at], codes)
            state[at] = trie.step(state[at], codes)
            levels.append((at, depth))
        # Walk again from the top, adding up per state.
        states = len(trie.check)
        n, going, leaves, saved, children = (np.zeros(states, np.int64) for _ in range(5))
        conv, row, deep = np.full(states, np.iinfo(np.int64).max), np.full(states, -1, np.int64), np.zeros(states, np.int64)
        seen = []
        state = np.full(rows, -1, np.int64)
        codes_used = 0
        for at, depth in levels:
            if not seen:
                before, codes = np.zeros(len(at), np.int64), f["shard"][at]
                codes_used = int(codes.max()) + 1
            else:
                before = state[at]
                codes, codes_used = _codes(before, xa[depth, at], codes_used)
            s = trie.step(before, codes)
            state[at] = s
            np.add.at(n, s, f["n"][at])
            np.minimum.at(conv, s, f["conv"][at])
            row[s], deep[s] = at, depth
            last = (size[at] == SEGMENT) & (depth == SEGMENT)
            np.add.at(going, s, np.where(last, f["going"][at], 0))
            seen.append(np.unique(s))
        for s in seen[1:]:
            np.add.at(children, trie.check[s], 1)
        for s in reversed(seen):
            saved[s] += (n[s] - 1) * chars[deep[s], row[s]]
            leaves[s] += (children[s] == 0) & (going[s] == 0)
            if s is not seen[0]:
                np.add.at(leaves, trie.check[s], leaves[s])
                np.add.at(saved, trie.check[s], saved[s])
        for i, s in enumerate(seen):
            r, d = row[s], deep[s]
            parent = trie.check[s]
            path = [None] * len(s)
            for j in np.flatnonzero(going[s] > 0).tolist():
                # from the shard's top down to the node itself
                path[j] = [{"ka": int(ka[k, r[j]]), "kb": int(kb[k, r[j]])} for k in range(int(cut[r[j]]), int(d[j]) + 1)]
            out.append(
                {
                    "upper": False, "top": i == 0, "ka": ka[d, r], "kb": kb[d, r], "pa": ka[d - 1, r], "pb": kb[d - 1, r],
                    "depth": f["seg"][r] * SEGMENT + d, "conv": conv[s], "parent_conv": conv[parent] if i else 0,
                    "n": n[s], "going": going[s], "chars": chars[d, r], "children": children[s], "leaves": leaves[s], "saved": saved[s], "path": path,
                }
            )
    return pd.concat([pd.DataFrame(o) for o in out], ignore_index=True).reindex(columns=COLUMNS)


def pack(rows: DataFrame, packed_rows: int = PACKED_ROWS) -> DataFrame:
    """Nodes of all shards, by tasks that each hold whole shards, a bounded
    number of rows at a time."""

    def flat(table: pa.Table) -> dict:
        turns = table.column("turns").combine_chunks()
        if isinstance(turns, pa.ChunkedArray):
            turns = pa.concat_arrays(turns.chunks) if turns.num_chunks else pa.array([], turns.type)
        items = turns.flatten()
        f = {c: table.column(c).to_numpy() for c in ("ka", "kb", "seg", "cut", "n", "conv", "going", "sa", "sb")}
        f.update({c: items.field(c).to_numpy(zero_copy_only=False) for c in ("xa", "xb", "chars")})
        f["size"] = turns.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        f["first"] = np.cumsum(f["size"]) - f["size"]
        f["cut"] = f["cut"].astype(np.int64)
        if not len(f["xa"]):
            f.update({c: np.zeros(1, np.int64) for c in ("xa", "xb", "chars")})
        new = np.ones(len(f["n"]), bool)
        new[1:] = (np.diff(f["sa"]) != 0) | (np.diff(f["sb"]) != 0) | (np.diff(f["cut"]) != 0)
        f["shard"] = np.cumsum(new) - 1
        return f

    def emit(table: pa.Table):
        nodes = _nodes(flat(table))
        for a in range(0, len(nodes), 20_000):
            yield pa.RecordBatch.from_pandas(nodes.iloc[a : a + 20_000], schema=schema, preserve_index=False)

    fields = [("upper", pa.bool_()), ("top", pa.bool_()), *[(c, pa.int64()) for c in COLUMNS[2:-1]]]
    schema = pa.schema([*fields, ("path", pa.list_(pa.struct([("ka", pa.int64()), ("kb", pa.int64())])))])

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(len(b) for b in held) < packed_rows:
                continue
            table = pa.Table.from_batches(held)
            sa, sb = table.column("sa").to_numpy(), table.column("sb").to_numpy()
            ends = np.flatnonzero((sa != sa[-1]) | (sb != sb[-1]))
            whole = int(ends[-1]) + 1 if len(ends) else 0
            if whole:  # the last shard may go on in the next batch
                yield from emit(table.slice(0, whole))
                held = table.slice(whole).to_batches()
        table = pa.Table.from_batches(held) if held else None
        if table is not None and len(table):
            yield from emit(table)

    columns = ["sa", "sb", "cut", "seg", *KEY, "n", "conv", "going", "turns"]
    sorted_ = rows.select(*columns).repartition("sa", "sb").sortWithinPartitions("sa", "sb", "cut")
    return sorted_.mapInArrow(run, NODE)


# --- figures across shards ---


def below(tree: DataFrame) -> DataFrame:
    """ka, kb, leaves, saved: the sums of each row of `tree` (ka, kb, pa, pb,
    leaves, saved; no parent for the root) and all below it."""
    tree = cut_lineage(tree)
    while not tree.filter("pa is not null").isEmpty():
        sums = tree.filter("pa is not null").groupBy(F.col("pa").alias("ka"), F.col("pb").alias("kb"))
        sums = sums.agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        new = tree.join(sums, KEY, "left").withColumns({c: F.col(c) + F.coalesce(f"more_{c}", F.lit(0)) for c in ("leaves", "saved")})
        new = cut_lineage(new.select(*KEY, "pa", "pb", "leaves", "saved"))
        ups = tree.filter("pa is not null").select(F.col("ka").alias("pa"), F.col("kb").alias("pb"), F.col("pa").alias("qa"), F.col("pb").alias("qb"))
        # Rows whose parent is the root have no further one.
        moved = spread_join(new.filter("pa is not null"), cut_lineage(ups), ["pa", "pb"], "left")
        moved = moved.select(*KEY, F.col("qa").alias("pa"), F.col("qb").alias("pb"), "leaves", "saved")
        tree = cut_lineage(new.filter("pa is null").unionByName(moved))
    return tree.select(*KEY, "leaves", "saved")


def ends(rows: DataFrame) -> DataFrame:
    """ka, kb, ends_sha256 of the nodes at which conversations end. Ids are
    joined in bounded pieces, and the pieces of a node hashed one after another."""
    last = rows.filter("not goes_on").select("conv_id", F.expr(f"ka ^ {_xor('turns', 'xa')}").alias("ka"), F.expr(f"kb ^ {_xor('turns', 'xb')}").alias("kb"))
    pieces = last.groupBy(*KEY, F.floor(F.col("conv_id") / JOINED).alias("piece")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))

    def run(batches):
        key, digest = None, None
        for pdf in batches:
            done = []
            for a, b, ids in zip(pdf["ka"], pdf["kb"], pdf["ids"], strict=True):
                if (a, b) == key:
                    digest.update(b"," + ids.encode())
                    continue
                if key is not None:
                    done.append((*key, digest.hexdigest()))
                key, digest = (a, b), hashlib.sha256(ids.encode())
            yield pd.DataFrame(done, columns=[*KEY, "ends_sha256"])
        if key is not None:
            yield pd.DataFrame([(*key, digest.hexdigest())], columns=[*KEY, "ends_sha256"])

    return pieces.repartition(*KEY).sortWithinPartitions(*KEY, "piece").mapInPandas(run, "ka long, kb long, ends_sha256 string")


def prefix_trie(turns: DataFrame, shard_rows: int | None = None, packed_rows: int = PACKED_ROWS) -> DataFrame:
    """One row per node of the trie of rebuilt conversations."""
    convs, said = rebuilt(turns)
    cut = cut_lineage(segments(convs, said))
    same = cut.groupBy("seg", *KEY, "turns").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv"), F.count_if("goes_on").alias("going"))
    found = cut_lineage(pack(shard(cut_lineage(same), shard_rows), packed_rows))

    parent = ["pa", "pb"]
    inner = found.filter("not upper").drop("upper")
    upper = found.filter("upper").groupBy(*KEY).agg(
        F.min("pa").alias("pa"), F.min("pb").alias("pb"), F.min("depth").alias("depth"), F.min("conv").alias("conv"),
        F.sum("n").alias("n"), F.sum("going").alias("going"), F.max("chars").alias("chars"),
    )
    upper = cut_lineage(upper)
    tops = inner.filter("top")
    hung = upper.filter("depth > 0").select(*parent).unionByName(tops.select(*parent))
    kids = cut_lineage(hung.groupBy(F.col("pa").alias("ka"), F.col("pb").alias("kb")).agg(F.count("*").alias("kids")))
    upper = upper.join(kids, KEY, "left").withColumn("children", F.coalesce("kids", F.lit(0).cast("long"))).drop("kids")
    upper = cut_lineage(upper.withColumns({"leaves": F.expr("cast(children = 0 as bigint)"), "saved": F.expr("(n - 1) * chars")}))

    # The tree above the shards, with what ends a segment inside a shard below
    # that shard's top.
    root = F.col("depth") == 0
    tree = upper.select(*KEY, *[F.when(~root, F.col(p)).alias(p) for p in parent], "leaves", "saved")
    tree = tree.unionByName(tops.select(*KEY, *parent, "leaves", "saved"))
    bridge = inner.filter("going > 0 and not top").select(*KEY, F.col("path")[0]["ka"].alias("pa"), F.col("path")[0]["kb"].alias("pb"))
    bridge = bridge.withColumns({"leaves": F.lit(0).cast("long"), "saved": F.lit(0).cast("long")})
    sums = cut_lineage(below(tree.unionByName(bridge)))

    # What later segments add inside a shard, along the path from its top.
    crossed = cut_lineage(inner.filter("going > 0 and not top").select(*KEY, "path"))
    more = crossed.join(sums, KEY).select(F.explode(F.expr("slice(path, 2, size(path))")).alias("p"), "leaves", "saved")
    more = more.groupBy(F.col("p.ka").alias("ka"), F.col("p.kb").alias("kb")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
    deep = inner.filter("not top").join(more, KEY, "left").join(kids, KEY, "left")
    deep = deep.withColumns({
        "leaves": F.col("leaves") + F.coalesce("more_leaves", F.lit(0)),
        "saved": F.col("saved") + F.coalesce("more_saved", F.lit(0)),
        "children": F.col("children") + F.coalesce("kids", F.lit(0)),
    })

    figures = [*KEY, "conv", "depth", "parent_conv", "n", "children"]
    shared = upper.drop("leaves", "saved").withColumn("top", F.lit(False))
    high = shared.unionByName(tops.drop("leaves", "saved", "parent_conv", "path").join(kids, KEY, "left").withColumn("children", F.col("children") + F.coalesce("kids", F.lit(0))).drop("kids"))
    high = high.join(sums, KEY)
    # Parents of these are shared nodes, or nodes that end a segment.
    names = upper.select(*KEY, "conv").unionByName(inner.filter("going > 0").select(*KEY, "conv"))
    names = cut_lineage(names.select(F.col("ka").alias("pa"), F.col("kb").alias("pb"), F.col("conv").alias("parent_conv")))
    below_root = cut_lineage(high.filter(~root))
    high = high.filter(root).withColumn("parent_conv", F.lit(None).cast("long")).select(*figures, "leaves", "saved").unionByName(
        spread_join(below_root, names, parent).select(*figures, "leaves", "saved"))

    nodes = high.unionByName(deep.select(*figures, "leaves", "saved")).join(ends(cut), KEY, "left")
    return nodes.select(
        F.col("conv").alias("conv_id"),
        "depth",
        F.col("parent_conv").alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


# The same rows by DuckDB: prefixes as lists, each node met with all above it.
ORACLE_SQL = """
with t as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, role, text) as place
  from conversations where conv_id is not null),
c as (
  select conv_id, conv_id - conv_id % 100 as base,
    xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda d: ascii(d)::bigint)),
      lambda crc, d: list_reduce(list_prepend(xor(crc, d), [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295::bigint) % 6 as h
  from (select distinct conv_id from t)),
s as (
  select conv_id, list(struct_pack(role := role, text := text) order by place) as said from t group by 1),
r as (
  select c.conv_id, coalesce(b.said[1:c.h], []) || coalesce(s.said[c.h + 1:], []) as said
  from c join s using (conv_id) left join s b on b.conv_id = c.base),
p as (
  select conv_id, d::bigint as depth, said[1:d] as said, len(said) = d as ends
  from r, unnest(range(len(said) + 1)) u(d)),
n as (
  select said, depth, min(conv_id) as conv_id, count(*)::bigint as n_convs,
    sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (ends), '')) as ends_sha256
  from p group by 1, 2),
k as (
  select said[1:depth - 1] as said, depth - 1 as depth, count(*)::bigint as n_children from n where depth > 0 group by 1, 2),
v as (
  select n.*, coalesce(n_children, 0) as n_children, (n_convs - 1) * coalesce(length(n.said[n.depth].text), 0) as saved
  from n left join k on k.depth = n.depth and k.said = n.said),
a as (
  select said[1:d] as said, d::bigint as depth, count(*) filter (n_children = 0)::bigint as n_leaves, sum(saved)::bigint as saved_tokens
  from v, unnest(range(depth + 1)) u(d) group by 1, 2)
select v.conv_id, v.depth, up.conv_id as parent_conv_id, v.n_convs, v.n_children, a.n_leaves, a.saved_tokens, v.ends_sha256
from v join a on a.depth = v.depth and a.said = v.said
left join v up on up.depth = v.depth - 1 and up.said = v.said[1:v.depth - 1]
"""

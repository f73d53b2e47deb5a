"""Whitening of embeddings by a covariance over weighted distinct vectors.

Entries become whole numbers, x = floor(1024 c) + 100000. Rows with the same x
fold to one with its multiplicity, in the map tasks already, so a vector that a
third of the rows share is one row from there on. The fit weighs each distinct
vector with its multiplicity, or with one. Each distinct vector is whitened
once and joined back by the SHA-256 of its x: the few that make up more than a
thousandth of all rows each (fewer than a thousand, whatever the table) by a
broadcast, all others by a shuffle.

The covariance is exact. Vectors are centred on the whole number next to the
mean and multiplied as a weighted matrix product; sums of whole numbers below
2^53 are exact in doubles and are added as decimals, and the rest of the centring
is done in whole numbers. So the order of tasks does not matter. What reaches
the driver are d sums and d (d + 1) / 2 products, d being the vectors' length.

Nulls and edges: rows whose vector is null, or holds null or non-finite entries,
are dropped; so are entries of 2^39 and beyond, which count as non-finite, and
empty vectors. Where lengths differ, vectors of the commonest length stay (of
equally common ones the longest). Null and repeated vec_ids keep a row
each. A component without variance has a null `whitened` and is left out of
`identity_error`; this is null if no component has any. Its `explained` is 0,
null if the vectors do not vary at all. A `deviation` beyond 64 bits is null.
An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
# Entries from here on count as non-finite: their x would leave 53 bits soon.
LARGE = float(1 << 39)
# A vector with more than this share of the rows joins by broadcast.
COMMON = 1000
EXACT = 1 << 53


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id, x of the rows that remain."""
    good = "embedding is not null and size(embedding) > 0 and forall(embedding, c -> coalesce(abs(cast(c as double)) < {0}D, false))"
    x = f"transform(embedding, c -> cast(floor({SCALE}D * cast(c as double)) as bigint) + {SHIFT})"
    # One expression, so that no entry is rounded before it is checked.
    rows = vectors.selectExpr("vec_id", f"if({good.format(LARGE)}, {x}, null) as x").filter("x is not null")
    sizes = rows.groupBy(F.size("x").alias("d")).count().agg(F.max(F.struct("count", "d")).alias("most"))
    d = sizes.first()["most"]
    return rows.filter(F.size("x") == F.lit(d["d"] if d else 0))


def key(x: str) -> str:
    return f"unhex(sha2(concat_ws(',', cast({x} as array<string>)), 256))"


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """key, x, n: each vector once, with its multiplicity."""
    counted = rows.groupBy("x").agg(F.count("*").alias("n"))
    return counted.selectExpr(f"{key('x')} as key", "x", "n")


def _matrix(column: pa.ChunkedArray | pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def sums(vectors: DataFrame, d: int) -> tuple[int, list[int]]:
    """The weight of all vectors and the weighted sum per dimension, exact."""
    total = vectors.agg(F.sum("w").alias("n")).first()["n"] or 0
    cells = vectors.select(F.posexplode("x").alias("i", "c"), "w").groupBy("i")
    found = cells.agg(F.sum(F.col("c").cast("decimal(19,0)") * F.col("w").cast("decimal(19,0)")).alias("s"))
    by = {r["i"]: int(r["s"]) for r in found.collect()}  # d rows
    return int(total), [by.get(i, 0) for i in range(d)]


def products(vectors: DataFrame, centre: list[int]) -> dict[tuple[int, int], int]:
    """Weighted products of the centred vectors, one per pair of dimensions."""
    d = len(centre)
    upper = np.triu_indices(d)

    def run(batches):
        total = np.zeros((d, d), object)
        for batch in batches:
            y = _matrix(batch.column("x"), d) - np.array(centre, np.int64)
            w = batch.column("w").to_numpy(zero_copy_only=False)
            largest = int(np.abs(y).max(initial=0))
            if largest**2 * int(w.sum()) < EXACT:
                z = y.astype(np.float64)
                total += (z.T @ (z * w[:, None])).astype(np.int64).astype(object)
            else:
                z = y.astype(object)
                total += z.T @ (z * w.astype(object)[:, None])
        values = pa.array([str(v) for v in total[upper]], pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(upper[0].astype(np.int32)), pa.array(upper[1].astype(np.int32)), values], ["i", "j", "g"])

    parts = vectors.select("x", "w").mapInArrow(run, "i int, j int, g string")
    whole = parts.groupBy("i", "j").agg(F.sum(F.col("g").cast("decimal(38,0)")).alias("g"))
    return {(r["i"], r["j"]): int(r["g"]) for r in whole.collect()}  # d (d + 1) / 2 rows


def covariance(n: int, total: list[int], centre: list[int], found: dict[tuple[int, int], int]) -> np.ndarray:
    """Each entry the double next to its exact value."""
    d = len(total)
    rest = [s - n * c for s, c in zip(total, centre, strict=True)]
    out = np.zeros((d, d))
    for i in range(d):
        for j in range(i, d):
            exact = Fraction(n * found.get((i, j), 0) - rest[i] * rest[j], n * n)
            out[i, j] = out[j, i] = float(exact)
    return out


def components(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first k eigenvalues and unit eigenvectors (rows), and whether each
    has variance beyond rounding. Signs are fixed by the largest entry."""
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:k], vectors.T[::-1][:k]
    largest = np.abs(vectors).argmax(axis=1)
    vectors = vectors * np.sign(vectors[np.arange(len(vectors)), largest])[:, None]
    varies = values > max(float(np.trace(v)), 0.0) * len(v) * np.finfo(float).eps
    return values, vectors, varies


def whiten(vectors: DataFrame, n: int, total: list[int], values: np.ndarray, axes: np.ndarray, varies: np.ndarray) -> DataFrame:
    """key, n, w, deviation and the coordinates of each distinct vector."""
    d = len(total)
    centre = [s // n for s in total]
    rest = np.array([s - n * c for s, c in zip(total, centre, strict=True)], object)
    shift = np.array([float(Fraction(int(r), n)) for r in rest])
    scale = np.where(varies, 1 / np.sqrt(np.where(varies, values, 1.0)), 0.0)
    turn = (axes * scale[:, None]).T

    def deviations(y: np.ndarray) -> list[int | None]:
        # sum of (n y - rest)^2, within 64 bits where that is sure
        reach = (n * int(np.abs(y).max(initial=0)) + n) ** 2 * d
        if reach < 1 << 63:
            z = n * y - rest.astype(np.int64)
            return (z * z).sum(axis=1).tolist()
        z = n * y.astype(object) - rest
        return [int(v) if v < 1 << 63 else None for v in (z * z).sum(axis=1)]

    def run(batches):
        for batch in batches:
            y = _matrix(batch.column("x"), d) - np.array(centre, np.int64)
            out = (y.astype(np.float64) - shift) @ turn
            coordinates = pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), out.shape[1]).cast(pa.list_(pa.float64()))
            deviation = pa.array(deviations(y), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("n"), batch.column("w"), deviation, coordinates], ["key", "n", "w", "deviation", "at"])

    return vectors.select("key", "n", "w", "x").mapInArrow(run, "key binary, n long, w long, deviation long, at array<double>")


def identity_error(whitened: DataFrame, n: int, varies: np.ndarray) -> float | None:
    """The largest entry of the coordinates' covariance less the identity."""
    on = [i for i in range(len(varies)) if varies[i]]
    if not on:
        return None
    w = "cast(w as double)"
    means = [F.expr(f"sum({w} * at[{i}])").alias(f"m{i}") for i in on]
    pairs = [(i, j) for i in on for j in on if i <= j]
    mixed = [F.expr(f"sum({w} * at[{i}] * at[{j}])").alias(f"p{i}_{j}") for i, j in pairs]
    r = whitened.agg(*means, *mixed).first()
    # The coordinates are centred before; their means are rounding only.
    return max(abs(r[f"p{i}_{j}"] / n - r[f"m{i}"] / n * r[f"m{j}"] / n - (i == j)) for i, j in pairs)


def whitened_rows(vectors: DataFrame, k: int = COMPONENTS, weights: str = "counts") -> DataFrame:
    """One row per remaining row of `vectors` (vec_id, embedding) and component.
    `weights`: "counts" fits over all rows, "one" over each distinct vector."""
    if weights not in ("counts", "one"):
        raise ValueError(weights)
    rows = quantised(vectors)
    found = distinct_vectors(rows).withColumn("w", F.col("n") if weights == "counts" else F.lit(1).cast("long"))
    found = cut_lineage(found)
    first = found.select(F.size("x").alias("d")).first()
    schema = "vec_id {0}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    schema = schema.format(dict(vectors.dtypes)["vec_id"])
    if first is None:
        return vectors.sparkSession.createDataFrame([], schema)
    d = first["d"]
    n, total = sums(found, d)
    centre = [round(Fraction(s, n)) for s in total]
    v = covariance(n, total, centre, products(found, centre))
    values, axes, varies = components(v, min(k, d))
    done = cut_lineage(whiten(found, n, total, values, axes, varies))
    error = identity_error(done, n, varies)
    trace = float(np.trace(v))
    shares = [float(e) / trace if on else 0.0 for e, on in zip(values, varies, strict=True)] if trace > 0 else [None] * len(values)

    def joined(keyed: DataFrame, vectors: DataFrame) -> DataFrame:
        return keyed.join(vectors, "key").select("vec_id", "deviation", "at")

    # Fewer than COMMON vectors can each have more than that share of the rows.
    n_rows = done.agg(F.sum("n")).first()[0]
    common = F.col("n") > F.lit(n_rows / COMMON)
    marked = done.select("key", "n", "deviation", "at")
    keyed = rows.selectExpr("vec_id", f"{key('x')} as key")
    many, few = F.broadcast(marked.filter(common)), marked.filter(~common)
    out = joined(keyed, many).unionByName(joined(keyed.join(many.select("key"), "key", "left_anti"), few))

    def constant(value):
        return F.lit(value).cast("double")

    each = F.array(*[F.struct(F.lit(i + 1).alias("component"), (F.col("at")[i] if varies[i] else constant(None)).alias("whitened"), constant(shares[i]).alias("explained")) for i in range(len(values))])
    out = out.select("vec_id", "deviation", F.explode(each).alias("c"))
    return out.select("vec_id", "c.component", F.lit(n).cast("long").alias("n"), "deviation", "c.whitened", "c.explained", constant(error).alias("identity_error"))

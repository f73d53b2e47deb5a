"""Values at given ranks of columns, exact, without sorting them as a whole.

One way for all sizes: a histogram of exact counts between the smallest and the
largest value, then one of the bucket that holds the rank, until that bucket holds
one value. A histogram has a bounded number of buckets, folds in the map tasks
and can be added up, and each round divides what is left by that number.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadpulse.functions.geo import number

PROBABILITIES = (0.10, 0.25, 0.50, 0.75, 0.90, 0.99)  # fixed values
BUCKETS = 4096


@dataclass(frozen=True)
class Bracket:
    """Values from `low` to `high` of a column, and how many lie below them."""

    column: str
    low: float
    high: float
    below: int

    def bucket(self) -> str:
        """SQL text: the bucket of a value within the bracket, in order."""
        v, width = f"cast({self.column} as double)", (self.high - self.low) / BUCKETS
        if not math.isfinite(width) or self.low + width == self.low:
            # Too narrow or too wide for equal steps: the largest value by itself.
            return f"if({v} = {_literal(self.high)}, 1L, 0L)"
        step = f"({v} - {_literal(self.low)}) / {number(width)}"
        return f"least(cast(floor({step}) as bigint), {BUCKETS - 1}L)"

    def holds(self) -> str:
        v = f"cast({self.column} as double)"
        return f"{v} between {_literal(self.low)} and {_literal(self.high)}"


def _literal(x: float) -> str:
    return number(x) if math.isfinite(x) else f"double('{x}')"


def extent(df: DataFrame, columns: list[str]) -> dict[str, tuple]:
    """Per column the number of values, the smallest and the largest."""
    kinds = {"n": F.count, "lo": F.min, "hi": F.max}
    sums = [f(F.col(c).cast("double")).alias(f"{k}_{c}") for c in columns for k, f in kinds.items()]
    r = df.agg(*sums).first()
    return {c: tuple(r[f"{k}_{c}"] for k in kinds) for c in columns}


def rank_values(
    df: DataFrame,
    columns: list[str],
    probabilities: tuple[float, ...] = PROBABILITIES,
    known: dict[str, tuple] | None = None,
) -> dict[str, list[float | None]]:
    """Per column the value at 0-based sorted position floor(p * n) for each p,
    nulls left out. `known` is the columns' extent, where the caller has it. All
    columns share each round's pass."""
    known = known or extent(df, columns)
    found: dict[tuple[str, float], float | None] = {}
    open_: dict[tuple[str, float], Bracket] = {}
    for c in columns:
        n, low, high = known[c]
        for p in probabilities:
            if not n:
                found[c, p] = None
            else:
                open_[c, p] = Bracket(c, low, high, 0)
    rank = {(c, p): min(int(p * known[c][0]), known[c][0] - 1) for c, p in open_}
    while True:
        for at, b in list(open_.items()):
            if b.low == b.high:
                found[at] = b.low
                del open_[at]
        if not open_:
            return {c: [found[c, p] for p in probabilities] for c in columns}
        counts = _histograms(df, sorted(set(open_.values()), key=str))
        for at, b in open_.items():
            below = b.below
            for n, low, high in counts[b]:
                if below + n > rank[at]:
                    open_[at] = Bracket(b.column, low, high, below)
                    break
                below += n


def _histograms(df: DataFrame, brackets: list[Bracket]) -> dict[Bracket, list[tuple]]:
    """Per bracket the counts, smallest and largest values of its buckets."""
    cases = [
        f"if({b.holds()}, struct({i} as i, {b.bucket()} as bucket, cast({b.column} as double) as v), null)"
        for i, b in enumerate(brackets)
    ]
    inside = df.select(F.explode(F.expr(f"array_compact(array({', '.join(cases)}))")).alias("b"))
    folded = inside.groupBy("b.i", "b.bucket").agg(F.count(F.lit(1)).alias("n"), F.min("b.v").alias("lo"), F.max("b.v").alias("hi"))
    # at most BUCKETS rows a bracket
    rows = sorted(folded.collect(), key=lambda r: (r["i"], r["bucket"]))
    out: dict[Bracket, list[tuple]] = {b: [] for b in brackets}
    for r in rows:
        out[brackets[r["i"]]].append((r["n"], r["lo"], r["hi"]))
    return out


def rank_quantiles(
    df: DataFrame, column: str, probabilities: tuple[float, ...] = PROBABILITIES
) -> DataFrame:
    """The value at 0-based sorted position floor(p * n), one row per p."""
    values = rank_values(df, [column], probabilities)[column]
    rows = [(float(p), v) for p, v in zip(probabilities, values, strict=True)]
    return df.sparkSession.createDataFrame(rows, "p double, value double")

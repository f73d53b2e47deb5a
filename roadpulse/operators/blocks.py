"""In-order clustering of ground that is too large for one group.

Connected ground is cut into blocks of cells. Each block is settled in order by
itself, with the places around it as a halo, whose roles are guessed at first:
they are settled along. Then every block is told the roles that its neighbours
found for its halo, and is settled again where they differ from what it used,
until none does. Roles depend on earlier places only, so what comes out is the one
solution there is, the same as a single pass gives; each round makes right at
least what hangs on blocks that are right. A guess near a block's edge goes wrong
only where a chain of places reaches it from outside, so a few rounds do, unless
the order follows the ground in even steps: then a chain crosses a block a round.

A place matters to the places within the radius, and whom it calls on depends on
those around it: a halo holds what lies within two cells, the roles of the nearer
one count. Blocks are as large as the bound allows where they are.
"""

from __future__ import annotations

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadpulse.operators import in_order
from roadpulse.operators.ground import CELL, occupied, with_ground_cell
from roadpulse.session import cut_lineage

cloudpickle.register_pickle_by_value(in_order)

AT = ["seq", "lat", "lon"]
TO = ["to", "to_lat", "to_lon"]
# Sides of a block in cells, as powers of two. Smaller ones would be mostly halo.
LEVELS = range(2, 9)
HALO = 2
OPEN = -1  # a role that is to be found


def _around(c: str, level: int, halo: int) -> str:
    """Blocks along one axis that reach a cell with their halo."""
    return f"sequence(({c} - {halo}) >> {level}, ({c} + {halo}) >> {level})"


def _reaching(cells: DataFrame, level: int, columns: list[str]) -> DataFrame:
    """A row per cell and block of one level that holds it or has it in its halo."""
    out = cells
    for c, b in zip(CELL, ("bx", "by", "bz")):
        out = out.withColumn(b, F.explode(F.expr(_around(c, level, HALO))))
    return out.select(*columns, F.lit(level).alias("level"), "bx", "by", "bz")


BLOCK = ["level", "bx", "by", "bz"]


def members(
    points: DataFrame, radius: float, keys: list[str], most: int, carry: list[str] | None = None
) -> DataFrame | None:
    """`points` with the block each belongs to (`core`), and once more for every
    block whose halo it is in (`near`: within one cell of it). Nothing if some
    ground is so dense that a block of the smallest side holds more than `most`
    rows with its halo. `carry` names what the rule needs beside place and way."""
    columns = [*keys, *AT, "bearing", *(carry or [])]
    placed = with_ground_cell(points.select(*columns), radius)
    cells = cut_lineage(occupied(placed, keys))
    every = _reaching(cells, LEVELS[0], [*keys, *CELL, "n"])
    for level in LEVELS[1:]:
        every = every.unionByName(_reaching(cells, level, [*keys, *CELL, "n"]))
    fits = every.groupBy(*keys, *BLOCK).agg(F.sum("n").alias("n")).filter(F.col("n") <= F.lit(most))
    own = [F.struct(F.lit(v).alias("level"), *[F.expr(f"{c} >> {v}").alias(b) for c, b in zip(CELL, BLOCK[1:])]) for v in LEVELS]
    homes = cells.select(*keys, *CELL, F.explode(F.array(*own)).alias("b")).select(*keys, *CELL, "b.*")
    homes = homes.join(fits.select(*keys, *BLOCK), [*keys, *BLOCK], "left_semi")
    home = homes.groupBy(*keys, *CELL).agg(F.max(F.struct(*BLOCK)).alias("home"))
    home = cut_lineage(cells.select(*keys, *CELL).join(home, [*keys, *CELL], "left"))
    if not home.filter("home is null").isEmpty():
        return None
    used = cut_lineage(home.select(*keys, "home.*").distinct())
    levels = sorted(r["level"] for r in used.select("level").distinct().collect())
    if not levels:
        return None
    held = None
    for level in levels:
        some = _reaching(cells, level, [*keys, *CELL])
        held = some if held is None else held.unionByName(some)
    held = held.join(used, [*keys, *BLOCK]).join(home, [*keys, *CELL])
    inside = F.col("home") == F.struct(*BLOCK)
    close = [F.expr(f"{b} between shiftright({c} - 1, level) and shiftright({c} + 1, level)") for c, b in zip(CELL, BLOCK[1:])]
    held = held.select(
        *keys,
        *CELL,
        F.xxhash64(*keys, *BLOCK).alias("block_id"),
        inside.alias("core"),
        (close[0] & close[1] & close[2]).alias("near"),
    )
    return placed.join(held, [*keys, *CELL]).drop(*CELL)


def greedy_roles(radius: float):
    """The clustering rule: 0 joins, 1 waits for a later one, 2 is a centre. A
    covered place that nobody calls on goes nowhere."""

    def decide(pdf, by):
        covered = pdf["covered"].to_numpy() if "covered" in pdf else None
        return in_order.settle_groups(pdf, by, radius, covered, pdf["given"].to_numpy())

    return decide


def settle(
    held: DataFrame, keys: list[str], batches, decide, order: list[str] | None = None, log: list | None = None
) -> DataFrame:
    """Where each place goes (`to`, `miles`) and its `role`, from the rows that
    `members` gives; places that go nowhere have no row. `decide(frame, by)`
    gives targets, miles and roles of a frame sorted by `by` and then `order`,
    roles other than `OPEN` in its column `given` being settled. `batches` groups
    rows by block for the grouped function; `log` takes the number of blocks
    settled in each round."""

    def run(rows, n):
        return cut_lineage(_settled(rows, keys, n, batches, decide, order or AT))

    held = cut_lineage(held)
    rows = held.count()
    place = [*keys, *AT]
    found = run(held.withColumn("given", F.lit(OPEN)), rows)
    if log is not None:
        log.append(held.select("block_id").distinct().count())
    owned = found.filter("core")
    guesses = found.filter("near and not core").select(*place, "block_id", F.col("role").alias("guess"))
    wrong = guesses.join(owned.select(*place, "role"), place).filter("guess != role")
    stale = cut_lineage(wrong.select("block_id").distinct())
    halo = held.filter("near and not core").select(*place, "block_id")
    while True:
        n = stale.count()
        if n == 0:
            return owned.filter("goes").select(*place, "bearing", *TO, "miles", "role")
        if log is not None:
            log.append(n)
        again = held.join(stale, "block_id", "left_semi")
        roles = owned.select(*place, F.col("role").alias("told"))
        # Roles of the outer halo do not count; whom the inner one calls on does.
        given = F.when(F.col("core"), OPEN).when(F.col("near"), F.col("told")).otherwise(0)
        again = cut_lineage(again.join(roles, place).withColumn("given", given).drop("told"))
        new = run(again, again.count()).filter("core")
        before = owned.select(*place, F.col("role").alias("was"))
        changed = new.join(before, place).filter("role != was").select(*place)
        stale = cut_lineage(halo.join(changed, place, "left_semi").select("block_id").distinct())
        owned = cut_lineage(owned.join(new.select("block_id").distinct(), "block_id", "left_anti").unionByName(new))


def _settled(rows: DataFrame, keys: list[str], n: int, batches, decide, order: list[str]) -> DataFrame:
    kinds = dict(rows.dtypes)
    names = ["block_id", *keys, "seq", "lat", "lon", "bearing", "core", "near", "role", "goes", *TO, "miles"]
    kind = {**kinds, "role": "int", "goes": "boolean", "to": kinds["seq"], "to_lat": "double", "to_lon": "double", "miles": "double"}
    schema = ", ".join(f"{c} {kind[c]}" for c in names)
    by = ["block_id", *keys]

    def roles(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([*by, *order], ignore_index=True)
        target, miles, role = decide(pdf, by)
        goal = {t: pdf[c].to_numpy()[target] for t, c in zip(TO, AT)}
        return pdf.assign(**goal, miles=miles, role=role, goes=target >= 0)[names]

    return batches(rows, by, n).applyInPandas(roles, schema)

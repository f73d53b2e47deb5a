"""Chat formatting of logged conversations, after collapsing snapshots.

A log that is written again after every turn holds each conversation many
times, each a prefix of the next. Every turn gets a hash of all turns up to it;
a conversation whose last hash is an inner hash of a longer one is dropped, and
of equal conversations the smallest conv_id stays. What stays is rendered, one
row per turn, so that a conversation of any length is no single row.

Places and hashes come from ranges of sorted turns: each range counts on its
own, and what lies before it is added, so a long conversation spreads over
tasks. The hash of a prefix is the exclusive or of two 64-bit hashes of each
(place, role, text).

Nulls and edges: a null conv_id is one conversation of its own; a null turn
comes first; null roles render as `user`, null texts as empty, and compare as
they render; turns with equal numbers are ordered by role and text, repeated
rows count as turns. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

# The marks of the rendered format.
START, END = "<|im_start|>", "<|im_end|>"


def _ranged(turns: DataFrame) -> DataFrame:
    """Turns with their range, and their place in it for their conversation."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sorted_ = rows.repartitionByRange("conv_id", "turn", "role", "text")
    placed = cut_lineage(sorted_.withColumn("part", F.spark_partition_id()))
    own = Window.partitionBy("conv_id", "part").orderBy("turn", "role", "text")
    return placed.withColumn("place", F.row_number().over(own).cast("long"))


def _carried(parts: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Per (conv_id, part), each aggregate over the parts before it."""
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = [F.coalesce(F.expr(f"{how}({c})").over(before), F.lit(0).cast("long")).alias(f"{c}_before") for c, how in columns.items()]
    return parts.select("conv_id", "part", *sums)


def _same_conversation(left: DataFrame, right: DataFrame, extra: list[str]) -> DataFrame:
    """Inner join on conv_id, null like any other value, and `extra`."""
    r = right.withColumnRenamed("conv_id", "conv_2")
    on = F.col("conv_id").eqNullSafe(F.col("conv_2"))
    for c in extra:
        r = r.withColumnRenamed(c, f"{c}_2")
        on = on & (F.col(c) == F.col(f"{c}_2"))
    return left.join(r, on).drop("conv_2", *[f"{c}_2" for c in extra])


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, position, role, text, h1, h2: the hash of all turns so far."""
    rows = cut_lineage(_ranged(turns))
    counts = _carried(rows.groupBy("conv_id", "part").agg(F.count("*").alias("n")), {"n": "sum"})
    at = _same_conversation(rows, counts, ["part"]).withColumn("position", F.col("place") + F.col("n_before"))
    for i in (1, 2):
        at = at.withColumn(f"x{i}", F.xxhash64("position", "role", "text", F.lit(i)))
    own = Window.partitionBy("conv_id", "part").orderBy("position")
    at = cut_lineage(at.withColumns({f"h{i}": F.expr(f"bit_xor(x{i})").over(own) for i in (1, 2)}))
    sums = at.groupBy("conv_id", "part").agg(*[F.expr(f"bit_xor(x{i})").alias(f"x{i}") for i in (1, 2)])
    carried = _carried(sums, {"x1": "bit_xor", "x2": "bit_xor"})
    out = _same_conversation(at.drop("x1", "x2"), carried, ["part"])
    hashes = [F.col(f"h{i}").bitwiseXOR(F.col(f"x{i}_before")).alias(f"h{i}") for i in (1, 2)]
    return out.select("conv_id", "position", "role", "text", *hashes)


def maximal(found: DataFrame) -> DataFrame:
    """(conv_id, n_turns) of conversations that are no prefix of a longer one."""
    ends = found.groupBy("conv_id").agg(F.max(F.struct("position", "h1", "h2")).alias("end"))
    ends = cut_lineage(ends.select("conv_id", F.col("end.position").alias("n_turns"), "end.h1", "end.h2"))
    whole = ends.groupBy("n_turns", "h1", "h2").agg(F.min("conv_id").alias("conv_id"))
    inner = found.select("conv_id", F.col("position").alias("n_turns"), "h1", "h2")
    # A conversation's own last hash is told from inner ones by its length.
    longer = _same_conversation(inner, ends.select("conv_id", F.col("n_turns").alias("of")), []).filter("n_turns < of")
    return whole.join(longer.select("n_turns", "h1", "h2").distinct(), ["n_turns", "h1", "h2"], "left_anti").select("conv_id", "n_turns")


def collapse_and_render(turns: DataFrame) -> DataFrame:
    """One row per turn of each conversation kept: conv_id, n_turns, position
    (from 1), role, rendered."""
    found = cut_lineage(prefixes(turns))
    kept = _same_conversation(found, maximal(found), [])
    line = F.concat(F.lit(START), F.col("role"), F.lit("\n"), F.col("text"), F.lit(f"{END}\n"))
    return kept.select("conv_id", "n_turns", "position", "role", line.alias("rendered"))


# The same rows by DuckDB: each conversation as a list, each prefix compared.
ORACLE_SQL = """
with t as (
  select conv_id, coalesce(role, 'user') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, 'user'), coalesce(text, '')) as position
  from conversations),
p as (
  select conv_id, position,
    list(role || chr(1) || text) over (partition by conv_id order by position) as said
  from t),
n as (select conv_id, max(position) as n_turns from t group by 1),
whole as (
  select min(p.conv_id) as conv_id, p.position as n_turns, p.said
  from p join n on n.conv_id is not distinct from p.conv_id and n.n_turns = p.position group by 2, 3),
inner_ as (
  select distinct p.said from p join n on n.conv_id is not distinct from p.conv_id and p.position < n.n_turns),
kept as (select conv_id, n_turns from whole anti join inner_ using (said))
select t.conv_id, kept.n_turns, t.position, t.role,
  '<|im_start|>' || t.role || chr(10) || t.text || '<|im_end|>' || chr(10) as rendered
from t join kept on kept.conv_id is not distinct from t.conv_id
"""

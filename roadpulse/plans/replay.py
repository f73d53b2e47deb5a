"""Replay of a history of incidents, interval by interval."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadpulse.params import CrispParams
from roadpulse.session import scratch_path, scratch_scope
from roadpulse.sources.incidents import with_reason
from roadpulse.streaming.run import IntervalRunner
from roadpulse.streaming.store import FILE_ROWS, RunStore, partition_values


# Bad rows are kept as what batch 0 set aside.
BAD_BATCH = 0


def replay(
    incidents: DataFrame,
    root: str,
    params: CrispParams,
    last_interval: int | None = None,
    quantiles: bool | None = None,
) -> RunStore:
    """Steps through all intervals in ascending order, up to `last_interval` if
    given, and returns the store with every version.

    The history is put in one folder per interval first, in one pass, bad rows
    beside good ones. Every interval is committed by itself: a replay that was
    cut short goes on after the last one that was, and puts only what is new in
    folders. Rows that cannot take part go to the quarantine, and
    to the late table go those of intervals before that one that never had a
    step. Intervals that had one are taken as counted.
    """
    spark = incidents.sparkSession
    runner = IntervalRunner(spark, root, params, quantiles=quantiles)
    done = runner.store.latest()
    stepped = []
    if done:
        stepped = [r[0] for r in runner.store.metrics().select("interval_id").collect()]
    rows = with_reason(incidents).withColumn("is_good", F.col("bad_reason").isNull())
    if stepped:
        rows = rows.filter(~F.col("is_good") | ~F.col("interval_id").isin(stepped))
    with scratch_scope(spark):
        _step_through(rows, runner, done, last_interval)
    return runner.store


def _step_through(rows: DataFrame, runner: IntervalRunner, done, last_interval: int | None) -> None:
    spark = rows.sparkSession
    path = scratch_path(spark, "history")
    kept = rows.withColumn("at", F.when(F.col("is_good"), F.col("interval_id")).otherwise(0))
    writer = kept.hint("rebalance", "at").write.option("maxRecordsPerFile", FILE_ROWS)
    writer.partitionBy("is_good", "at").parquet(path)
    folders = [F.col("is_good"), F.col("at")]
    schema = kept.drop(*folders).schema.add("is_good", "boolean").add("at", "integer")
    staged = spark.read.schema(schema).parquet(path)
    good = staged.filter("is_good").drop("bad_reason", "value", "is_good")
    ids = partition_values(spark, f"{path}/is_good=true", "at")
    if partition_values(spark, f"{path}/is_good=false", "at"):
        bad = staged.filter("not is_good").drop("is_good", "at")
        runner.store.write_aside("quarantine", bad, BAD_BATCH)
    late = [t for t in ids if done and t <= done.interval_id]
    if late:
        runner.store.write_aside("late", good.filter(F.col("at").isin(late)).drop("at"), done.batch_id)
    for t in ids:
        if t not in late and (last_interval is None or t <= last_interval):
            runner.run_batch(good.filter(f"at = {t}").drop("at"), t, [t])

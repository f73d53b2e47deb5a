"""Drive steps over batches of incidents: from a stream or from a table."""

from __future__ import annotations

import time
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from roadpulse.operators.ranks import rank_values
from roadpulse.operators.report import interval_metrics
from roadpulse.operators.state import advance_idle
from roadpulse.params import CrispParams, FuzzyParams
from roadpulse.plans.step import interval_step, state_of
from roadpulse.session import scratch_path, scratch_scope
from roadpulse.sources.incidents import with_reason
from roadpulse.streaming.store import FILE_ROWS, RunStore, Version, partition_values


class IntervalRunner:
    """Applies batches in order of `batch_id`, each as its intervals in
    ascending order, and keeps every version in a `RunStore`."""

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        params: CrispParams,
        id_type: T.DataType | None = None,
        quantiles: bool | None = None,
    ):
        self.params = params
        self.fuzzy = isinstance(params, FuzzyParams)
        self.quantiles = self.fuzzy if quantiles is None else quantiles
        self.store = RunStore(spark, root, id_type or T.LongType(), self.fuzzy)
        self._newest: Version | None = None

    def run_batch(
        self,
        batch: DataFrame,
        batch_id: int,
        seen: list[int] | None = None,
        hold_newest: bool = False,
    ) -> None:
        """`seen` names the intervals in the batch where the caller knows them
        and has set aside what cannot take part. Rows of closed intervals go to
        the late table, rows that cannot take part to the quarantine.

        With `hold_newest` the newest interval stays open: its rows are parked
        until a later interval comes, or until `flush`, so that an interval may
        arrive in any number of files and batches.
        """
        prior = self._prior(batch_id)
        if seen is None:
            batch = with_reason(batch)
            bad = F.col("bad_reason").isNotNull()
            found = batch.groupBy("interval_id").agg(
                F.count_if(bad).alias("bad"), F.count_if(~bad).alias("good")
            )
            found = found.collect()
            if any(r["bad"] for r in found):
                self.store.write_aside("quarantine", batch.filter(bad), batch_id)
            seen = [r["interval_id"] for r in found if r["good"]]
            batch = batch.filter(~bad).drop("bad_reason", "value")
        last = prior.interval_id if prior else None
        late = [t for t in seen if last is not None and t <= last]
        if late:
            self.store.write_aside("late", batch.filter(F.col("interval_id") <= last), batch_id)
        open_ids = set(seen) - set(late)
        if hold_newest:
            parts = self._open_parts(batch_id, last)
            open_ids |= {t for _, t in parts}
            if not open_ids:
                return
            newest = max(open_ids)
            if newest in seen:
                self.store.park(batch.filter(F.col("interval_id") == newest), batch_id, newest)
            open_ids.remove(newest)
            carried = [(b, t) for b, t in parts if t != newest]
            if carried:
                parked = self.store.read_parked(carried)
                batch = batch.unionByName(parked, allowMissingColumns=True)
        self._run_intervals(batch, batch_id, sorted(open_ids), prior)

    def flush(self) -> None:
        """Closes the intervals that are still open. The number of the version
        follows the last one used, and must not be that of a batch to come."""
        parked = self.store.parked()
        if not parked:
            return
        prior = self.store.latest()
        batch_id = max([b for b, _ in parked] + ([prior.batch_id] if prior else [])) + 1
        parts = self._open_parts(batch_id, prior.interval_id if prior else None)
        if parts:
            rows = self.store.read_parked(parts)
            self._run_intervals(rows, batch_id, sorted({t for _, t in parts}), prior)

    def _open_parts(self, batch_id: int, last: int | None) -> list[tuple[int, int]]:
        """What batches before this one parked and no version has counted."""
        found = self.store.parked()
        return [(b, t) for b, t in found if b < batch_id and (last is None or t > last)]

    def _run_intervals(
        self, batch: DataFrame, batch_id: int, open_ids: list[int], prior: Version | None
    ) -> None:
        if not open_ids:
            return
        batch = batch.filter(F.col("interval_id").isin(open_ids))
        staged = None
        with scratch_scope(self.store.spark):
            if len(open_ids) > 1:
                staged, _ = stage_by_interval(batch)
            rows = []
            for t in open_ids:
                part = (staged if staged is not None else batch).filter(F.col("interval_id") == t)
                with scratch_scope(self.store.spark):
                    prior, row = self._run_interval(part, batch_id, t, prior)
                rows.append(row)
            self.store.write_metrics(rows, batch_id)
        self._newest = prior

    def _prior(self, batch_id: int) -> Version | None:
        if self._newest is not None and self._newest.batch_id < batch_id:
            return self._newest
        return self.store.latest(before=batch_id)

    def _run_interval(self, part: DataFrame, batch_id: int, interval_id: int, prior):
        p = self.params
        began = time.monotonic()
        state = self.store.read_state(prior)
        n_state = prior.n_state if prior else 0
        idle = interval_id - prior.interval_id - 1 if prior else 0
        if idle > 0 and n_state > 0:
            state = advance_idle(state, idle, p.decay_rate, p.delete_threshold, self.fuzzy)
            state = state.persist()
            n_state = state.count()
        result = interval_step(part, state, p, interval_id, n_state)
        wrote = time.monotonic()
        self.store.write_outcome(result.outcome, batch_id, interval_id)
        written = self.store.read_outcome(Version(batch_id, interval_id, 0))
        metrics, fv, sd = self._measure(written)
        done = time.monotonic()
        result.release()
        if idle > 0 and n_state > 0:
            state.unpersist()
        version = Version(batch_id, interval_id, metrics["n_state"])
        row = (
            interval_id,
            result.n_incidents,
            metrics["n_assigned"],
            metrics["n_new"],
            metrics["n_deleted"],
            metrics["n_state"],
            metrics["n_reported"],
            metrics.get("n_dense"),
            metrics.get("n_sparse"),
            metrics["fv_min"],
            metrics["fv_max"],
            metrics.get("sd_min"),
            metrics.get("sd_max"),
            fv,
            sd,
            result.timings["match_seconds"],
            result.timings["cluster_seconds"],
            done - wrote,
            done - began,
        )
        return version, row

    def _measure(self, written: DataFrame):
        """All figures of the interval in one pass; ranks start from its extremes."""
        columns = ["fitness", "sd"] if self.fuzzy else ["fitness"]
        alive = F.col("status") != "deleted"
        sizes = [F.count(F.when(alive, F.col(c))).alias(f"n_{c}") for c in columns]
        got = interval_metrics(written, extra=sizes if self.quantiles else None).first().asDict()
        if not self.quantiles:
            return got, None, None
        known = {"fitness": (got["n_fitness"], got["fv_min"], got["fv_max"])}
        if self.fuzzy:
            known["sd"] = (got["n_sd"], got["sd_min"], got["sd_max"])
        ranks = rank_values(state_of(written), columns, known=known)
        return got, ranks["fitness"], ranks.get("sd")


def stage_by_interval(incidents: DataFrame) -> tuple[DataFrame, list[int]]:
    """Incidents in one folder per interval, so that every step reads its own
    interval only, and the intervals there are. Rebalancing splits intervals
    that hold many rows over several tasks, and each of these its rows over files
    that the tasks of a step share out. All rows have an interval."""
    spark = incidents.sparkSession
    path = scratch_path(spark, "intervals")
    rows = incidents.hint("rebalance", "interval_id")
    rows.write.partitionBy("interval_id").option("maxRecordsPerFile", FILE_ROWS).parquet(path)
    kept = [f for f in incidents.schema if f.name != "interval_id"]
    schema = T.StructType(kept + [T.StructField("interval_id", T.IntegerType())])
    staged = spark.read.schema(schema).parquet(path)
    return staged, partition_values(spark, path, "interval_id")


def run_stream(
    incidents: DataFrame,
    root: str,
    checkpoint: str,
    params: CrispParams,
    available_now: bool = True,
    processing_time: str | None = None,
    timeout_seconds: float | None = None,
    quantiles: bool | None = None,
) -> StreamingQuery:
    """Steps over a streaming table of incidents with an `interval_id`, either
    parsed lines as they are or rows of one's own; what cannot take part goes to
    the quarantine.

    An interval is closed when a later one is seen, and with `available_now` at
    the end, when the call returns: what is there has then been worked off.
    Otherwise the query goes on, at most `timeout_seconds` if given, and the
    newest interval waits. Versions of a run are numbered twice the batch, so
    that the closing of the last interval has a number of its own.
    """
    runner = IntervalRunner(incidents.sparkSession, root, params, quantiles=quantiles)
    running: list[StreamingQuery] = []
    noted: set[int] = set()

    def note_delays() -> None:
        """A batch's scheduling delay is known once it is over: each batch, and
        the end, writes what the ones before left."""
        for p in running[0].recentProgress if running else []:
            delay = scheduling_ms(p)
            if delay is not None and int(p["batchId"]) not in noted:
                runner.store.write_delay(delay, int(p["batchId"]))
                noted.add(int(p["batchId"]))

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        """A step reads its batch more than once; the files are parsed once."""
        note_delays()
        batch.persist()
        started, began = datetime.now(timezone.utc), time.monotonic()
        try:
            runner.run_batch(batch, 2 * batch_id, hold_newest=True)
            took = int(1000 * (time.monotonic() - began))
            runner.store.write_progress((started, batch.count(), took), batch_id)
        finally:
            batch.unpersist()

    writer = incidents.writeStream.foreachBatch(on_batch)
    writer = writer.option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    query = writer.start()
    running.append(query)
    if timeout_seconds is not None:
        if not query.awaitTermination(timeout_seconds):
            query.stop()
        note_delays()
    elif available_now:
        query.awaitTermination()
        note_delays()
        runner.flush()
    return query


def scheduling_ms(progress) -> int | None:
    """Time of a trigger outside the batch's own work; none if it had no batch."""
    d = progress["durationMs"]
    if "addBatch" not in d:
        return None
    return int(d.get("triggerExecution", 0)) - int(d["addBatch"])


def progress_metrics(query: StreamingQuery) -> DataFrame:
    """Rows, start and durations of the recent micro-batches of a query, as Spark
    keeps them; `RunStore.progress` has every batch."""
    spark = query.sparkSession if hasattr(query, "sparkSession") else SparkSession.active()
    rows = []
    for p in query.recentProgress:
        d = p["durationMs"]
        work = int(d.get("addBatch", 0))
        total = int(d.get("triggerExecution", 0))
        rows.append((int(p["batchId"]), p["timestamp"], int(p["numInputRows"]), total - work, work))
    return spark.createDataFrame(
        rows,
        "batch_id long, started string, n_rows long, scheduling_ms long, processing_ms long",
    )

"""Versioned tables of a run.

    <root>/state/batch_id=B/interval_id=T/status=...   outcome of interval T
    <root>/metrics/batch_id=B                          written last: the commit
    <root>/late/batch_id=B                             rows of closed intervals
    <root>/quarantine/batch_id=B                       rows that cannot take part
    <root>/progress/batch_id=B                         how a stream's batch went
    <root>/delays/batch_id=B                           how long it had to wait
    <root>/parked/batch_id=B/interval_id=T             rows of an interval still open

A batch writes only below its own id and overwrites what an earlier attempt
left there, so a retry gives the same tables. Its metrics rows mark it done.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadpulse.schema import hotspot_schema

METRICS_SCHEMA = (
    "interval_id int, n_incidents long, n_assigned long, n_new long, n_deleted long, "
    "n_state long, n_reported long, n_dense long, n_sparse long, "
    "fv_min double, fv_max double, sd_min double, sd_max double, "
    "fv_quantiles array<double>, sd_quantiles array<double>, "
    "match_seconds double, cluster_seconds double, write_seconds double, total_seconds double"
)

# Rows of a file of incidents: a step costs far more time than a row has bytes, so
# its tasks go by rows, and a scan never cuts a small file.
FILE_ROWS = 50_000

PROGRESS_SCHEMA = "started timestamp, n_rows long, processing_ms long"


@dataclass(frozen=True)
class Version:
    batch_id: int
    interval_id: int
    n_state: int


def partition_values(
    spark: SparkSession, path: str, column: str, finished: bool = False
) -> list[int]:
    """Sorted numbers in the folder names `<column>=<number>`, without opening
    a file; with `finished` only of folders whose write was completed."""
    jvm = spark._jvm
    top = jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(top):
        return []
    out = []
    for entry in fs.listStatus(top):
        name, _, value = entry.getPath().getName().partition("=")
        marker = jvm.org.apache.hadoop.fs.Path(entry.getPath(), "_SUCCESS")
        if name == column and value.isdigit() and (not finished or fs.exists(marker)):
            out.append(int(value))
    return sorted(out)


class RunStore:
    def __init__(self, spark: SparkSession, root: str, id_type: T.DataType, fuzzy: bool):
        self.spark = spark
        self.root = root.rstrip("/")
        self.state_schema = hotspot_schema(id_type, fuzzy)
        self.outcome_schema = T.StructType(
            self.state_schema.fields
            + [
                T.StructField("n_assigned", T.LongType()),
                T.StructField("is_new", T.BooleanType()),
                T.StructField("status", T.StringType()),
            ]
        )

    def _committed(self) -> list[int]:
        """Ids of finished batches."""
        return partition_values(self.spark, f"{self.root}/metrics", "batch_id", finished=True)

    def latest(self, before: int | None = None) -> Version | None:
        """The newest finished version, of batches below `before` if given."""
        done = [b for b in self._committed() if before is None or b < before]
        if not done:
            return None
        rows = self.spark.read.schema(METRICS_SCHEMA).parquet(
            f"{self.root}/metrics/batch_id={done[-1]}"
        )
        last = rows.agg(F.max(F.struct("interval_id", "n_state")).alias("m")).first()["m"]
        return Version(done[-1], last["interval_id"], last["n_state"])

    def outcome_path(self, batch_id: int, interval_id: int) -> str:
        return f"{self.root}/state/batch_id={batch_id}/interval_id={interval_id}"

    def read_outcome(self, version: Version) -> DataFrame:
        path = self.outcome_path(version.batch_id, version.interval_id)
        return self.spark.read.schema(self.outcome_schema).parquet(path)

    def read_state(self, version: Version | None) -> DataFrame:
        if version is None:
            return self.spark.createDataFrame([], self.state_schema)
        alive = self.read_outcome(version).filter(F.col("status").isin("kept", "reported"))
        return alive.select(*self.state_schema.names)

    def write_outcome(self, outcome: DataFrame, batch_id: int, interval_id: int) -> None:
        rows = outcome.select(*[F.col(f.name).cast(f.dataType) for f in self.outcome_schema])
        rows.write.mode("overwrite").partitionBy("status").parquet(
            self.outcome_path(batch_id, interval_id)
        )

    def write_aside(self, kind: str, rows: DataFrame, batch_id: int) -> None:
        """`kind` is late or quarantine."""
        rows.write.mode("overwrite").parquet(f"{self.root}/{kind}/batch_id={batch_id}")

    def read_aside(self, kind: str) -> DataFrame | None:
        """Rows set aside by all batches, or None where there are none."""
        found = partition_values(self.spark, f"{self.root}/{kind}", "batch_id", finished=True)
        if not found:
            return None
        reader = self.spark.read.option("basePath", f"{self.root}/{kind}")
        return reader.parquet(*[f"{self.root}/{kind}/batch_id={b}" for b in found])

    def parked_path(self, batch_id: int, interval_id: int) -> str:
        return f"{self.root}/parked/batch_id={batch_id}/interval_id={interval_id}"

    def park(self, rows: DataFrame, batch_id: int, interval_id: int) -> None:
        writer = rows.write.mode("overwrite").option("maxRecordsPerFile", FILE_ROWS)
        writer.parquet(self.parked_path(batch_id, interval_id))

    def parked(self) -> list[tuple[int, int]]:
        """(batch, interval) of all that was parked so far."""
        top = f"{self.root}/parked"
        return [
            (b, t)
            for b in partition_values(self.spark, top, "batch_id")
            for t in partition_values(self.spark, f"{top}/batch_id={b}", "interval_id", finished=True)
        ]

    def read_parked(self, parts: list[tuple[int, int]]) -> DataFrame:
        return self.spark.read.parquet(*[self.parked_path(b, t) for b, t in parts])

    def write_metrics(self, rows: list[tuple], batch_id: int) -> None:
        df = self.spark.createDataFrame(rows, METRICS_SCHEMA).coalesce(1)
        df.write.mode("overwrite").parquet(f"{self.root}/metrics/batch_id={batch_id}")

    def write_progress(self, row: tuple, batch_id: int) -> None:
        df = self.spark.createDataFrame([row], PROGRESS_SCHEMA).coalesce(1)
        df.write.mode("overwrite").parquet(f"{self.root}/progress/batch_id={batch_id}")

    def write_delay(self, scheduling_ms: int, batch_id: int) -> None:
        df = self.spark.createDataFrame([(scheduling_ms,)], "scheduling_ms long").coalesce(1)
        df.write.mode("overwrite").parquet(f"{self.root}/delays/batch_id={batch_id}")

    def progress(self) -> DataFrame:
        """One row for every batch of the stream that was worked off. The delay
        of a batch is written by the next one, or at the end of the run."""
        read = self.spark.read
        rows = read.schema("batch_id long, " + PROGRESS_SCHEMA).parquet(f"{self.root}/progress")
        if not partition_values(self.spark, f"{self.root}/delays", "batch_id"):
            return rows.withColumn("scheduling_ms", F.lit(None).cast("long"))
        delays = read.schema("batch_id long, scheduling_ms long").parquet(f"{self.root}/delays")
        return rows.join(delays, "batch_id", "left")

    def metrics(self) -> DataFrame:
        schema = "batch_id long, " + METRICS_SCHEMA
        rows = self.spark.read.schema(schema).parquet(f"{self.root}/metrics")
        return rows.filter(F.col("batch_id").isin(self._committed()))

    def outcomes(self) -> DataFrame:
        """Outcomes of all finished batches; filters on interval and status prune."""
        schema = T.StructType(
            [f for f in self.outcome_schema if f.name != "status"]
            + [
                T.StructField("batch_id", T.LongType()),
                T.StructField("interval_id", T.IntegerType()),
                T.StructField("status", T.StringType()),
            ]
        )
        rows = self.spark.read.schema(schema).parquet(f"{self.root}/state")
        return rows.filter(F.col("batch_id").isin(self._committed()))

    def hotspots(self) -> DataFrame:
        """Reported hot spots of all intervals."""
        return self.outcomes().filter(F.col("status") == "reported")

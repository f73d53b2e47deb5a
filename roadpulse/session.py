"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "roadpulse", master: str | None = None, **conf) -> SparkSession:
    """A session with adaptive execution and skew splitting on. Anything the
    cluster already sets can be passed through `conf`."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Distance joins cost more per byte than plain ones: split hot cells early.
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64m",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32m",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    settings.update(conf)
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder. A folder of our own is made only
    on a local master that names none."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="roadpulse-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


# Paths handed out in the scopes that a thread is in, innermost last.
_scopes = threading.local()


def _open_scopes() -> list[list[str]]:
    if not hasattr(_scopes, "stack"):
        _scopes.stack = []
    return _scopes.stack


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared checkpoint folder."""
    path = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
    if _open_scopes():
        _open_scopes()[-1].append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """What is written to scratch paths within it is deleted when it ends, on
    failure too: what is to stay must have been written elsewhere by then, and
    frames made within it must not be read any more."""
    paths: list[str] = []
    _open_scopes().append(paths)
    try:
        yield
    finally:
        _open_scopes().remove(paths)
        hadoop = spark._jvm.org.apache.hadoop.fs
        for path in paths:
            at = hadoop.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and read them back: computed once,
    no plan behind them, and a lost executor costs a re-read."""
    path = scratch_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

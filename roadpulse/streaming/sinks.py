"""Sinks for reported hot spots and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame

from roadpulse.operators.report import format_hotspots, output_line


def write_hotspots(
    reported: DataFrame, path: str, fmt: str = "parquet", fuzzy: bool = False
) -> None:
    """One folder per interval. `fmt` is parquet, or tsv for text lines without
    a header. Only the intervals present are replaced."""
    if fmt == "tsv":
        rows = reported.select("interval_id", output_line(fuzzy).alias("line"))
    else:
        rows = reported
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer = writer.partitionBy("interval_id")
    writer.text(path) if fmt == "tsv" else writer.parquet(path)


def write_latest(reported: DataFrame, path: str, fuzzy: bool = False) -> None:
    """One folder that always holds the newest interval only."""
    format_hotspots(reported, fuzzy).write.mode("overwrite").text(path)


def write_history(history: DataFrame, path: str) -> None:
    """Tab-separated export with a header, for a map."""
    history.write.mode("overwrite").option("sep", "\t").option("header", "true").csv(path)

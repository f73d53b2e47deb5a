"""Incident files: comma-separated lines, one file (or folder) per interval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadpulse.functions.geo import road_key
from roadpulse.schema import INCIDENT_FIELDS, INCIDENT_SCHEMA

DELIMITER = ","
WHOLE_NUMBER = r"^[+-]?[0-9]+$"


def parse_incident_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Splits raw lines by position and types the fields.

    Quotes have no meaning and fields past the last known one are ignored. A
    field that does not parse, or that a short line lacks, becomes null;
    `bad_reason` then says why the row is of no use. Other columns of `lines`
    are kept.
    """
    parts = F.split(F.col(column), DELIMITER)
    out = lines.withColumn("_parts", parts)
    for pos, name in enumerate(INCIDENT_FIELDS):
        out = out.withColumn(name, _typed(F.get("_parts", F.lit(pos)), name))
    return with_reason(out.drop("_parts"))


def with_reason(incidents: DataFrame) -> DataFrame:
    """Adds `bad_reason`: why a row cannot take part, else null. A reason that
    is already there stays; a frame with intervals needs one in every row."""
    reason = _bad_reason()
    if "bad_reason" in incidents.columns:
        reason = F.coalesce("bad_reason", reason)
    if "interval_id" in incidents.columns:
        no_interval = F.when(F.col("interval_id").isNull(), F.lit("interval"))
        reason = F.coalesce(reason, no_interval)
    return incidents.withColumn("bad_reason", reason)


def _typed(raw: Column, name: str) -> Column:
    kind = INCIDENT_SCHEMA[name].dataType.simpleString()
    if kind == "double":
        return raw.try_cast("double")
    if kind == "int":
        return F.when(raw.rlike(WHOLE_NUMBER), raw.try_cast("int"))
    return raw


def _bad_reason() -> Column:
    lat, lon = F.col("lat"), F.col("lon")
    return (
        F.when(lat.isNull() | ~lat.between(-90.0, 90.0), F.lit("latitude"))
        .when(lon.isNull() | F.isnan(lon) | (F.abs(lon) == float("inf")), F.lit("longitude"))
        .when(F.col("bearing").isNull(), F.lit("bearing"))
        .when(F.col("road").isNull(), F.lit("road"))
    )


def _interval_of(path: Column) -> Column:
    """Interval number from `<name>_<i>.csv` or a folder `interval_id=<i>`."""
    by_name = F.regexp_extract(path, r"_(\d+)\.csv(?:/[^/]*)?$", 1)
    by_folder = F.regexp_extract(path, r"interval_id=(\d+)/", 1)
    return F.coalesce(
        F.nullif(by_folder, F.lit("")), F.nullif(by_name, F.lit(""))
    ).try_cast("int")


def _from_text(lines: DataFrame) -> DataFrame:
    at = lines.select("value", _interval_of(F.col("_metadata.file_path")).alias("interval_id"))
    return parse_incident_lines(at)


def read_incident_csv(spark: SparkSession, *paths: str) -> DataFrame:
    """Good and bad rows of the interval files, told apart by `bad_reason`."""
    reader = spark.read.option("recursiveFileLookup", "true")
    return _from_text(reader.text(list(paths)))


def stream_incident_csv(
    spark: SparkSession, directory: str, files_per_trigger: int | None = None
) -> DataFrame:
    """The same rows as a stream over the files that appear in a folder. The
    interval comes from the file name, not from the order of arrival; all files
    that are there come in one batch unless `files_per_trigger` says less."""
    reader = spark.readStream.option("recursiveFileLookup", "true")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return _from_text(reader.text(directory))


def good_rows(parsed: DataFrame) -> DataFrame:
    keep = ["interval_id"] if "interval_id" in parsed.columns else []
    return parsed.filter(F.col("bad_reason").isNull()).select(*keep, *INCIDENT_FIELDS)


def quarantine_rows(parsed: DataFrame) -> DataFrame:
    """Rows that cannot take part, as they were read."""
    keep = ["interval_id"] if "interval_id" in parsed.columns else []
    return parsed.filter(F.col("bad_reason").isNotNull()).select(*keep, "value", "bad_reason")


def keyed_incidents(incidents: DataFrame) -> DataFrame:
    """Typed position, a comparable road, and age zero."""
    return incidents.withColumns(
        {
            "lat": F.col("lat").cast("double"),
            "lon": F.col("lon").cast("double"),
            "bearing": F.col("bearing").cast("int"),
            "road_key": F.expr(road_key("road")),
            "age": F.lit(0),
        }
    )


def with_seq(df: DataFrame, order: str = "id") -> DataFrame:
    """The number that fixes who comes first. `id` follows the incident id; ids
    that are missing or no whole numbers count by a hash of the row. `hash` takes
    the hash for all, which keeps chains of decisions short when ids follow the
    course of a road. Equal numbers are told apart by place."""
    text = F.col("incident_id").cast("string")
    hashed = F.xxhash64(text, "road", "lat", "lon", "bearing")
    if order == "hash":
        return df.withColumn("seq", hashed)
    number = F.when(text.rlike(WHOLE_NUMBER), text.try_cast("long"))
    return df.withColumn("seq", F.coalesce(number, hashed))


def assign_interval(df: DataFrame, hours: int, origin: str, ts: str = "ts") -> DataFrame:
    """Interval number, from 1, of the tumbling window the time falls in."""
    span = hours * 3600
    at = F.col(ts).cast("timestamp_ntz")
    seconds = F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ '{origin}', _t)")
    return (
        df.withColumn("_t", at)
        .withColumn("interval_id", (F.floor(seconds / F.lit(span)) + 1).cast("int"))
        .drop("_t")
    )


def add_event_time(incidents: DataFrame, pattern: str = "yyyy-MM-dd HH:mm:ss") -> DataFrame:
    """Time stamp from the date and time fields; null where they do not parse."""
    text = F.concat_ws(" ", F.col("date"), F.col("time"))
    return incidents.withColumn(
        "ts", F.try_to_timestamp(text, F.lit(pattern)).cast("timestamp_ntz")
    )

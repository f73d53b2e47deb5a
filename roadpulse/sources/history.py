"""Tab-separated hot spot exports with a header row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadpulse.schema import HISTORY_SCHEMA


def read_hotspot_history(spark: SparkSession, path: str) -> DataFrame:
    """Columns are found by their name in the header, in any case and order;
    others are left out, and one that is missing is null. The files of a folder
    share one header. Doubles are read back exactly as written."""
    raw = spark.read.option("sep", "\t").option("header", "true").csv(path)
    named = {c.lower(): c for c in raw.columns}

    def column(field):
        given = named.get(field.name.lower())
        text = F.lit(None) if given is None else F.col(f"`{given}`")
        return text.try_cast(field.dataType).alias(field.name)

    return raw.select(*map(column, HISTORY_SCHEMA))

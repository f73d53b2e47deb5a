"""Table schemas."""

from __future__ import annotations

from pyspark.sql import types as T

# Positions of the fields in an incident line: fixed values.
INCIDENT_FIELDS = [
    "incident_id",
    "lat",
    "lon",
    "bearing",
    "vehicle_make",
    "road",
    "full_location",
    "date",
    "time",
    "weekday",
]

INCIDENT_SCHEMA = T.StructType(
    [
        T.StructField("incident_id", T.StringType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("lon", T.DoubleType()),
        T.StructField("bearing", T.IntegerType()),
        T.StructField("vehicle_make", T.StringType()),
        T.StructField("road", T.StringType()),
        T.StructField("full_location", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("time", T.StringType()),
        T.StructField("weekday", T.StringType()),
    ]
)

# Columns of an exported history that a heat map reads: fixed values.
HISTORY_SCHEMA = T.StructType(
    [
        T.StructField("DayID", T.IntegerType()),
        T.StructField("Road", T.StringType()),
        T.StructField("Bearing", T.IntegerType()),
        T.StructField("Latitude", T.DoubleType()),
        T.StructField("Longitude", T.DoubleType()),
        T.StructField("Fitness", T.DoubleType()),
        T.StructField("Age", T.IntegerType()),
    ]
)


def hotspot_schema(id_type: T.DataType, fuzzy: bool) -> T.StructType:
    """State table; ids keep the type of the incident ids they come from."""
    fields = [
        T.StructField("hs_id", id_type),
        T.StructField("road_key", T.StringType()),
        T.StructField("road", T.StringType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("lon", T.DoubleType()),
        T.StructField("bearing", T.IntegerType()),
        T.StructField("fitness", T.DoubleType()),
        T.StructField("age", T.IntegerType()),
        T.StructField("created_interval", T.IntegerType()),
        T.StructField("last_interval", T.IntegerType()),
    ]
    if fuzzy:
        fields += [
            T.StructField("sd", T.DoubleType()),
            T.StructField("density_label", T.StringType()),
            T.StructField("n_added", T.LongType()),
            T.StructField("dist_sum", T.DoubleType()),
        ]
    return T.StructType(fields)

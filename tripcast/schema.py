"""Fixed schemas of the trip tables and the default 2018 calendar."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference for equal results.
# Day-type calendar of 2018: long holidays (day type 2) and the weekend days
# that were made working days (day type 0).
HOLIDAYS_2018 = [
    "2018-01-01", "2018-02-15", "2018-02-16", "2018-02-17", "2018-02-18",
    "2018-02-19", "2018-02-20", "2018-02-21", "2018-04-05", "2018-04-06",
    "2018-04-07", "2018-04-29", "2018-04-30", "2018-05-01", "2018-06-16",
    "2018-06-17", "2018-06-18",
]
MAKEUP_WORKDAYS_2018 = ["2018-02-11", "2018-02-24", "2018-04-08", "2018-04-28"]
# Train / test cutoff: test trips start at or after this instant.
SPLIT_CUTOFF = "2018-06-23 00:00:00"
# Geohash base32 alphabet.
GEOHASH_ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"
# Earth radii in metres (equator, pole) used by both distance formulas.
EQUATOR_RADIUS_M = 6378140.0
POLAR_RADIUS_M = 6356755.0
# ---------------------------------------------------------------------------

HOLIDAY = "holiday"
WORKDAY = "workday"

CALENDAR_SCHEMA = T.StructType([
    T.StructField("date", T.DateType(), False),
    T.StructField("kind", T.StringType(), False),
])


def train_schema(id_type: T.DataType = T.StringType()) -> T.StructType:
    """Past trips: trip id, person, start / end time, start / end point."""
    return T.StructType([
        T.StructField("r_key", id_type, True),
        T.StructField("out_id", id_type, True),
        T.StructField("start_time", T.TimestampNTZType(), True),
        T.StructField("end_time", T.TimestampNTZType(), True),
        T.StructField("start_lat", T.DoubleType(), True),
        T.StructField("start_lon", T.DoubleType(), True),
        T.StructField("end_lat", T.DoubleType(), True),
        T.StructField("end_lon", T.DoubleType(), True),
    ])


def test_schema(id_type: T.DataType = T.StringType()) -> T.StructType:
    """Trips to predict: like past trips without ``end_time``."""
    return T.StructType([f for f in train_schema(id_type).fields if f.name != "end_time"])


def prediction_schema(id_type: T.DataType = T.StringType()) -> T.StructType:
    """Truth and predicted end point per test trip (one file set per k)."""
    return T.StructType([
        T.StructField("r_key", id_type, True),
        T.StructField("end_lat", T.DoubleType(), True),
        T.StructField("end_lon", T.DoubleType(), True),
        T.StructField("end_lat_pre", T.DoubleType(), True),
        T.StructField("end_lon_pre", T.DoubleType(), True),
        T.StructField("k", T.IntegerType(), True),
    ])


def result_schema(id_type: T.DataType = T.StringType()) -> T.StructType:
    """Rows of the result table: one stored prediction with its error."""
    return T.StructType([
        T.StructField("r_key", id_type, True),
        T.StructField("lat", T.DoubleType(), True),
        T.StructField("lon", T.DoubleType(), True),
        T.StructField("dis", T.DoubleType(), True),
        T.StructField("type", T.StringType(), True),
        T.StructField("k", T.IntegerType(), True),
    ])


def prediction_file_schema(id_type: T.DataType = T.StringType()) -> T.StructType:
    """Trips to predict with what the weighted predictor made of them."""
    return T.StructType([
        *test_schema(id_type).fields,
        T.StructField("period", T.IntegerType()), T.StructField("week_code", T.IntegerType()),
        T.StructField("start_code", T.StringType()), T.StructField("predict", T.StringType()),
        T.StructField("k", T.IntegerType())])

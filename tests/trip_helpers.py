"""Fixture path and trip tables shared by the tests (not a conftest: pytest
reads several modules of that name)."""

from pyspark.sql import functions as F

SF_SMALL = "/root/testdata/sf0.001"


def trips_frame(spark, rows):
    """rows: (r_key, out_id, 'yyyy-mm-dd hh:mm:ss', end_time|None, slat, slon, elat, elon)."""
    df = spark.createDataFrame(
        rows, "r_key long, out_id long, start_time string, end_time string, "
              "start_lat double, start_lon double, end_lat double, end_lon double")
    return (df.withColumn("start_time", F.col("start_time").cast("timestamp_ntz"))
            .withColumn("end_time", F.col("end_time").cast("timestamp_ntz")))

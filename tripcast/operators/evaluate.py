"""Scoring of predictions and simple table summaries (O-31 ... O-36)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripcast.functions.geo import ellipsoid_m
from tripcast.functions.metrics import trip_score
from tripcast.schema import SPLIT_CUTOFF


def with_error(pred: DataFrame) -> DataFrame:
    """Ellipsoid distance between truth and prediction (null when invalid)."""
    return pred.withColumn("dis", ellipsoid_m("end_lat", "end_lon", "end_lat_pre", "end_lon_pre"))


def evaluate(pred: DataFrame, by: Sequence[str] = ("k",), near_m: float = 500.0,
             test: DataFrame | None = None) -> DataFrame:
    """Per group: rows, invalid rows, mean distance, mean score, count and
    share strictly under ``near_m`` metres, largest distance (O-31); with the
    trips to predict ``test`` also ``coverage``, the share of them that has a
    prediction row (a trip has at most one a group).

    Invalid rows (null / NaN coordinates) are excluded from every mean and
    counted in ``invalid_count``; a group without a valid row has null means
    and a null share.
    """
    df = with_error(pred)
    d = F.col("dis")
    valid = F.count(d)
    near = F.count_if(d < near_m)
    out = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        (F.count(F.lit(1)) - valid).alias("invalid_count"),
        F.avg(d).alias("mean_dis"),
        F.avg(trip_score(d)).alias("mean_score"),
        near.alias("lt_500_count"),
        F.try_divide(near, valid).alias("lt_500_share"),
        F.max(d).alias("max_dis"))
    if test is None:
        return out
    trips = test.agg(F.count(F.lit(1)).alias("__trips")).scalar()
    return out.withColumn("coverage", F.try_divide(F.col("n"), trips))


def coverage(pred: DataFrame, test: DataFrame, by: Sequence[str] = ("k",), key: str = "r_key") -> DataFrame:
    """Per group: trips with a prediction, trips to predict and their share;
    persons without history have no prediction, so this counts them."""
    trips = test.agg(F.count_distinct(key).alias("test_trips"))
    found = pred.groupBy(*by).agg(F.count_distinct(key).alias("predicted"))
    return found.join(F.broadcast(trips)).select(  # one row
        *by, "predicted", "test_trips", F.try_divide("predicted", "test_trips").alias("coverage"))


def evaluate_buckets(results: DataFrame, by: Sequence[str] = ("type", "k")) -> DataFrame:
    """Per run: mean score and cumulative counts at 100, 200, 500, 1000 m
    (inclusive) and above 1000 m (O-32). An empty run has no row; a run
    without valid distances has a null mean."""
    d = F.col("dis")
    return results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(trip_score(d)).alias("mean_score"),
        F.count_if(d <= 100).alias("le_100"),
        F.count_if(d <= 200).alias("le_200"),
        F.count_if(d <= 500).alias("le_500"),
        F.count_if(d <= 1000).alias("le_1000"),
        F.count_if(d > 1000).alias("gt_1000"))


def persons(test: DataFrame, col: str = "out_id") -> DataFrame:
    """Distinct persons with trips to predict (O-34)."""
    return test.select(col).distinct()


def trip_counts(trips: DataFrame, col: str = "out_id") -> DataFrame:
    """Trips per person (O-35)."""
    return trips.groupBy(col).agg(F.count(F.lit(1)).alias("n_trips"))


def split_sizes(trips: DataFrame, cutoff: str = SPLIT_CUTOFF) -> DataFrame:
    """Row counts of the whole table and of both sides of the split, plus the
    column counts of each side (O-36), in one aggregation."""
    t = F.lit(cutoff).cast("timestamp_ntz")
    n_cols = len(trips.columns)
    return trips.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("start_time") < t).alias("n_train"),
        F.count_if(F.col("start_time") >= t).alias("n_test"),
    ).withColumn("n_cols", F.lit(n_cols)).withColumn("n_test_cols", F.lit(n_cols - 1))

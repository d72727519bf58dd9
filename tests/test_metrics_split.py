import math

from pyspark.sql import functions as F

from tripcast.functions.metrics import pair_metric_l2, pair_metric_log, pair_metric_root, trip_score
from tripcast.operators.features import split_by_time

from trip_helpers import trips_frame


def test_pair_metrics(spark):
    rows = [(3, 3, 0, 0, 110.0, 110.0),        # same longitude -> NaN
            (3, 3, 0, 0, 110.0, 110.000001),   # gap < 1 m, same hour and day -> negative sum
            (5, 3, 1, 0, 110.0, 111.0),
            (3, 3, 1, 0, 110.0, 111.0)]        # same hour -> -Infinity in the log metric
    df = spark.createDataFrame(rows, "h int, h2 int, d int, d2 int, lo double, lo2 double")
    got = df.select(
        pair_metric_root("h", "h2", "d", "d2", "lo", "lo2").alias("r"),
        pair_metric_root("h", "h2", "d", "d2", "lo", "lo2", clamp=True).alias("rc"),
        pair_metric_log("h", "h2", "d", "d2", "lo", "lo2").alias("g"),
        pair_metric_l2(F.lit(1.0), F.lit(1.0), "lo", "lo2", "h", "h2", "d", "d2").alias("e")).collect()
    assert math.isnan(got[0].r) and math.isnan(got[0].g)
    assert math.isnan(got[1].r) and got[1].rc == 0.0 and got[1].g == float("-inf")
    gap = 6378140 * math.radians(1.0)
    assert got[2].r == round(math.sqrt(4 + 1 + math.log10(gap * gap)), 6)
    assert got[2].g == round(math.log10(4) + math.log10(1) + math.log10(gap * gap), 6)
    assert got[3].g == float("-inf")
    assert got[2].e == round(math.sqrt(1 + 4 + 1), 9)


def test_score(spark):
    got = spark.range(1).select(trip_score(F.lit(1000.0)).alias("s")).first().s
    assert got == 0.5


def test_split_edges(spark):
    t = trips_frame(spark, [
        (1, 1, "2018-06-22 23:59:59", "2018-06-23 00:10:00", 30.0, 110.0, 30.1, 110.1),
        (2, 1, "2018-06-23 00:00:00", "2018-06-23 00:10:00", 30.0, 110.0, 30.1, 110.1),
        (3, 1, None, None, 30.0, 110.0, 30.1, 110.1)])
    train, test = split_by_time(t)
    assert [r.r_key for r in train.collect()] == [1]
    assert [r.r_key for r in test.collect()] == [2]
    assert "end_time" not in test.columns

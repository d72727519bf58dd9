"""Projections and filters over trip tables (O-07 ... O-11b)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripcast.functions.geo import round5, with_geohash
from tripcast.functions.time import day_type, hour_of, with_day_type
from tripcast.schema import HOLIDAYS_2018, MAKEUP_WORKDAYS_2018, SPLIT_CUTOFF


def split_by_time(trips: DataFrame, cutoff: str = SPLIT_CUTOFF,
                  drop_end_time: bool = True) -> tuple[DataFrame, DataFrame]:
    """Past trips start before ``cutoff``; trips to predict start at or after
    it (O-08). A null start time falls on neither side."""
    t = F.lit(cutoff).cast("timestamp_ntz")
    train = trips.filter(F.col("start_time") < t)
    test = trips.filter(F.col("start_time") >= t)
    if drop_end_time and "end_time" in test.columns:
        test = test.drop("end_time")
    return train, test


def trips_of(trips: DataFrame, person) -> DataFrame:
    """Trips of one person (O-09), or of the persons of a table with
    ``out_id`` (pipelines join on the person instead)."""
    if isinstance(person, DataFrame):
        return trips.join(person.select("out_id"), "out_id", "left_semi")
    return trips.filter(F.col("out_id") == F.lit(person))


def drop_invalid(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Keep rows whose given columns are all numbers (O-10)."""
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(c).isNotNull() & ~F.isnan(F.col(c))
    return df.filter(cond)


POINTS = ("start_lat", "start_lon", "end_lat", "end_lon")


def invalid_trips(trips: DataFrame, cols: Sequence[str] = POINTS) -> DataFrame:
    """How many trips the feature step leaves out: ``(n, invalid)``."""
    bad = F.col("start_time").isNull()
    for c in cols:
        bad = bad | F.col(c).isNull() | F.isnan(F.col(c))
    return trips.agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("invalid"))


def _time_features(df: DataFrame, ts: str, hour_out: str, day_out: str,
                   holidays: Sequence[str], workdays: Sequence[str],
                   calendar: DataFrame | None) -> DataFrame:
    df = df.withColumn(hour_out, hour_of(ts))
    if calendar is not None:
        return with_day_type(df, ts, day_out, calendar)
    return df.withColumn(day_out, day_type(ts, holidays, workdays))


def train_features(train: DataFrame, class_precision: int = 12, round_start: bool = False,
                   holidays: Sequence[str] = HOLIDAYS_2018, workdays: Sequence[str] = MAKEUP_WORKDAYS_2018,
                   calendar: DataFrame | None = None) -> DataFrame:
    """Past-trip feature rows (O-07): person, trip key, hour, day type, start
    point, rounded end point and its geohash ``class``. Trips without a valid
    time, start or end point are left out (see :func:`invalid_trips`)."""
    df = drop_invalid(train.filter(F.col("start_time").isNotNull()), POINTS).select(
        F.col("r_key").alias("nb_key"), "out_id", "start_time",
        (round5("start_lat") if round_start else F.col("start_lat")).alias("start_lat"),
        (round5("start_lon") if round_start else F.col("start_lon")).alias("start_lon"),
        round5("end_lat").alias("end_lat"), round5("end_lon").alias("end_lon"),
    )
    df = _time_features(df, "start_time", "hour", "type_of_day", holidays, workdays, calendar)
    df = with_geohash(df, "end_lat", "end_lon", "class", class_precision)
    return df.drop("start_time")


def test_features(test: DataFrame, round_start: bool = True,
                  holidays: Sequence[str] = HOLIDAYS_2018, workdays: Sequence[str] = MAKEUP_WORKDAYS_2018,
                  calendar: DataFrame | None = None) -> DataFrame:
    """Feature rows of trips to predict (O-07), suffixed ``2`` as in the
    reference's SQL, with the true end point riding along. Trips without a
    valid time or start point are left out."""
    df = drop_invalid(test.filter(F.col("start_time").isNotNull()), POINTS[:2]).select(
        "r_key", F.col("out_id").alias("out_id2"), "start_time",
        (round5("start_lat") if round_start else F.col("start_lat")).alias("start_lat2"),
        (round5("start_lon") if round_start else F.col("start_lon")).alias("start_lon2"),
        F.col("end_lat").alias("end_lat2"), F.col("end_lon").alias("end_lon2"),
    )
    df = _time_features(df, "start_time", "hour2", "type_of_day2", holidays, workdays, calendar)
    return df.drop("start_time")


def trip_features(trips: DataFrame, kind: str = "train", **kw) -> DataFrame:
    """Feature projection of either side (O-07)."""
    if kind == "train":
        return train_features(trips, **kw)
    if kind == "test":
        return test_features(trips, **kw)
    raise ValueError("kind must be 'train' or 'test'")


def register_views(spark: SparkSession, train: DataFrame, test: DataFrame,
                   train_view: str = "trip_record", test_view: str = "test_record") -> None:
    """Named views so that SQL users see the feature tables (O-11b)."""
    train.createOrReplaceTempView(train_view)
    test.createOrReplaceTempView(test_view)


@contextmanager
def cached(df: DataFrame, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> Iterator[DataFrame]:
    """Keep a frame that several views read for the length of a block: its
    sources are scanned once, at the first use, and the storage is released at
    the end, also after an error. Results must be computed inside the block."""
    kept = df.persist(level)
    try:
        yield kept
    finally:
        kept.unpersist(blocking=True)

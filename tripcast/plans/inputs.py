"""Shared inputs of the registered queries: trips derived from ``events``
and the feature tables of each reference variant."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripcast.functions.time import day_type, hour_of
from tripcast.operators.features import split_by_time, test_features, train_features
from tripcast.schema import SPLIT_CUTOFF
from tripcast.sources.events import fixture_trips, next_event, read_events, trips_before, trips_since


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture_trips(spark, sf_dir)


def split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Both sides of the split, each derived from the events of its own days
    (the past side looks ahead to one event a person)."""
    events = read_events(spark, sf_dir)
    return (split_by_time(trips_before(events, SPLIT_CUTOFF))[0], split_by_time(trips_since(events, SPLIT_CUTOFF))[1])


def sql_form_features(spark: SparkSession, sf_dir: str, parts=None) -> tuple[DataFrame, DataFrame]:
    """SQL form (and Bayes): test start rounded, 12-character classes."""
    tr, te = parts or split(spark, sf_dir)
    return train_features(tr, 12, round_start=False), test_features(te, round_start=True)


def queue_form_features(spark: SparkSession, sf_dir: str, parts=None) -> tuple[DataFrame, DataFrame]:
    """Queue form: past-trip start rounded, test start raw."""
    tr, te = parts or split(spark, sf_dir)
    return train_features(tr, 12, round_start=True), test_features(te, round_start=False)


def weighted_features(spark: SparkSession, sf_dir: str, parts=None) -> tuple[DataFrame, DataFrame]:
    """Distance-weighted form: raw starts, 8-character classes."""
    tr, te = parts or split(spark, sf_dir)
    return train_features(tr, 8, round_start=False), test_features(te, round_start=False)


def with_next_trip(trips_: DataFrame) -> DataFrame:
    """Each trip with ``next_r_key, next_start_time, next_start_lat,
    next_start_lon`` of the same person's next trip (by start time, key); null
    for the person's last one."""
    return next_event(trips_, "out_id", ["start_time", "r_key"], ["r_key", "start_time", "start_lat", "start_lon"])


def consecutive_trip_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each trip with the next trip of the same person (by start time, key):
    a bounded pairing over the whole table for the pair-metric queries.
    Columns: ``r_key, next_r_key`` and hour, day type, start point of both."""
    t = trips(spark, sf_dir).select("r_key", "out_id", "start_time", "start_lat", "start_lon")
    nxt = with_next_trip(t).filter(F.col("next_r_key").isNotNull())
    return nxt.select(
        "r_key", "next_r_key", "start_lat", "start_lon", "next_start_lat", "next_start_lon",
        hour_of("start_time").alias("hour"), day_type("start_time").alias("type_of_day"),
        hour_of("next_start_time").alias("next_hour"), day_type("next_start_time").alias("next_type_of_day"))

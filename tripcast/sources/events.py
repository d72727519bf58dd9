"""Trips derived from the ``events`` table (the shared test fixture).

A trip joins two consecutive events of one person ordered by ``(ts,
event_id)``; the last event of a person gives no trip. Coordinates come from
integer arithmetic divided once by 1e5, so every engine gives the same bits.

The "next event" is found without putting a whole person into one task
(see :func:`next_event`).
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values of the fixture derivation (shared with the SQL oracle).
EVENT_TYPE_CODES = {"click": 0, "view": 1, "purchase": 2, "signup": 3, "error": 4}
SHIFT_DAYS = 2040          # 2024-01-01 -> 2018-06-01
LAT_BASE, LAT_MUL_U, LAT_MUL_C, LAT_MOD = 2300000, 7919, 104729, 1700000
LON_BASE, LON_MUL_U, LON_MUL_C, LON_MOD = 10000000, 15485863, 32452843, 2000000
LAT_JITTER_MOD, LAT_JITTER_OFF = 200, 100
LON_JITTER_MOD, LON_JITTER_OFF = 173, 86
SCALE = 1e5
# ---------------------------------------------------------------------------

def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet")


def _type_code(c):
    expr = None
    for name, code in EVENT_TYPE_CODES.items():
        expr = (F.when(c == name, F.lit(code)) if expr is None else expr.when(c == name, F.lit(code)))
    return expr.cast("long")


def next_event(events: DataFrame, key: str, order: list[str], carry: list[str],
               piece: Column | None = None) -> DataFrame:
    """Attach ``next_<c>`` for each column in ``carry``: the values of the next
    row of the same ``key`` in ``order`` (null for the key's last row).

    A key's rows fall into pieces, by default of one day of the first order
    column; ``piece`` must be a date that grows with the order. The
    next row is found inside the piece, and a piece's last row takes the
    first row of the key's next piece, from a table with one row a piece. So
    a task orders one day of a key, and the plan is the same at every size.
    """
    day = F.to_date(order[0]) if piece is None else piece
    u = events.withColumn("__piece", F.coalesce(day, F.lit("0001-01-01").cast("date")))
    w = Window.partitionBy(key, "__piece").orderBy(*order)
    out = u.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in carry],
                   F.lead(F.lit(1)).over(w).alias("__has_next"))
    first = u.groupBy(F.col(key).alias("__key"), F.col("__piece").alias("__day")).agg(
        # one by one, so that a column nobody asks for is not read; all take the same row
        *[F.min_by(c, F.struct(*order)).alias(f"__first_{c}") for c in carry])
    wb = Window.partitionBy("__key").orderBy("__day")
    bridge = first.select(
        "__key", "__day", *[F.lead(f"__first_{c}").over(wb).alias(f"__bridge_{c}") for c in carry])
    out = out.join(bridge, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__piece") == F.col("__day")), "left")
    is_last = F.col("__has_next").isNull()
    return out.select(
        *[c for c in events.columns],
        *[F.when(is_last, F.col(f"__bridge_{c}")).otherwise(F.col(f"next_{c}")).alias(f"next_{c}") for c in carry])


def trips_from_events(events: DataFrame) -> DataFrame:
    """Trips ``(r_key, out_id, start_time, end_time, start_lat, start_lon,
    end_lat, end_lon)`` with ``TIMESTAMP_NTZ`` times."""
    ev = events.select(
        "event_id", "user_id",
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        _type_code(F.col("event_type")).alias("code"),
        F.floor(F.col("value") * F.lit(100.0)).cast("long").alias("m"),
    )
    ev = next_event(ev, "user_id", ["ts", "event_id"], ["ts", "code"])
    u, c, cn, m = F.col("user_id"), F.col("code"), F.col("next_code"), F.col("m")
    shift = F.make_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(SHIFT_DAYS))

    def lat(code, jitter):
        base = F.lit(LAT_BASE) + (u * LAT_MUL_U + code * LAT_MUL_C) % LAT_MOD
        if jitter:
            base = base + m % LAT_JITTER_MOD - LAT_JITTER_OFF
        return base.cast("double") / F.lit(SCALE)

    def lon(code, jitter):
        base = F.lit(LON_BASE) + (u * LON_MUL_U + code * LON_MUL_C) % LON_MOD
        if jitter:
            base = base + m % LON_JITTER_MOD - LON_JITTER_OFF
        return base.cast("double") / F.lit(SCALE)

    return ev.filter(F.col("next_ts").isNotNull()).select(
        F.col("event_id").alias("r_key"),
        u.alias("out_id"),
        (F.col("ts") - shift).alias("start_time"),
        (F.col("next_ts") - shift).alias("end_time"),
        lat(c, True).alias("start_lat"),
        lon(c, True).alias("start_lon"),
        lat(cn, False).alias("end_lat"),
        lon(cn, False).alias("end_lon"),
    )


def fixture_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trips_from_events(read_events(spark, sf_dir))


def event_cutoff(cutoff: str) -> str:
    """The event time that becomes the trip time ``cutoff``."""
    return (datetime.fromisoformat(cutoff) + timedelta(days=SHIFT_DAYS)).isoformat(sep=" ")


def trips_before(events: DataFrame, cutoff: str) -> DataFrame:
    """The trips that start before ``cutoff``, from the events before it and a
    bounded look-ahead: each person's first event from the cutoff on, found by
    a combined minimum, ends the last of those trips. The cutoff reaches both
    scans."""
    at = F.lit(event_cutoff(cutoff)).cast(events.schema["ts"].dataType)
    used = events.select("event_id", "user_id", "ts", "event_type", "value")
    later = used.filter(F.col("ts") >= at).groupBy("user_id").agg(
        F.min_by(F.struct("event_id", "ts", "event_type", "value"), F.struct("ts", "event_id")).alias("e"))
    early = used.filter(F.col("ts") < at)
    seen = early.unionByName(later.select("user_id", "e.*"))
    return trips_from_events(seen).filter(F.col("start_time") < F.lit(cutoff).cast("timestamp_ntz"))


def trips_since(events: DataFrame, cutoff: str) -> DataFrame:
    """The trips that start at ``cutoff`` or later: they need no earlier event."""
    return trips_from_events(events.filter(F.col("ts") >= F.lit(event_cutoff(cutoff)).cast(events.schema["ts"].dataType)))

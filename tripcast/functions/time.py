"""Hour bucket and day type of a trip start (O-15, O-16, O-17)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripcast.schema import HOLIDAY, HOLIDAYS_2018, MAKEUP_WORKDAYS_2018, WORKDAY


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hour_of(ts: str | Column) -> Column:
    """Hour of day 0..23 as int."""
    return F.hour(_col(ts)).cast("int")


def day_type(
    ts: str | Column,
    holidays: Sequence[str] = HOLIDAYS_2018,
    workdays: Sequence[str] = MAKEUP_WORKDAYS_2018,
) -> Column:
    """0 working day, 1 weekend, 2 long holiday.

    Tested in this order: holiday, made-up working day, Monday to Friday,
    Saturday or Sunday. A null time gives null.
    """
    d = F.to_date(_col(ts))
    dow = F.dayofweek(d)  # 1 = Sunday ... 7 = Saturday
    return (
        F.when(d.isNull(), F.lit(None))
        .when(d.isin([F.lit(x).cast("date") for x in holidays]), F.lit(2))
        .when(d.isin([F.lit(x).cast("date") for x in workdays]), F.lit(0))
        .when(dow.isin(1, 7), F.lit(1))
        .otherwise(F.lit(0))
        .cast("int")
    )


def with_day_type(df: DataFrame, ts: str, out: str, calendar: DataFrame) -> DataFrame:
    """Day type from a calendar table ``(date DATE, kind STRING)``.

    The calendar has one row per date; whether it is broadcast is decided
    from its real size at run time, without a job of its own.
    """
    cal = calendar.select(
        F.col("date").alias("__cal_date"),
        F.when(F.col("kind") == HOLIDAY, 2).when(F.col("kind") == WORKDAY, 0).alias("__cal_type"),
    ).dropDuplicates(["__cal_date"])
    d = F.to_date(F.col(ts))
    joined = df.join(cal, d == F.col("__cal_date"), "left")
    dow = F.dayofweek(d)
    value = (
        F.when(d.isNull(), F.lit(None))
        .when(F.col("__cal_type").isNotNull(), F.col("__cal_type"))
        .when(dow.isin(1, 7), F.lit(1))
        .otherwise(F.lit(0))
        .cast("int")
    )
    return joined.withColumn(out, value).drop("__cal_date", "__cal_type")


def calendar_frame(spark, holidays: Sequence[str] = HOLIDAYS_2018,
                   workdays: Sequence[str] = MAKEUP_WORKDAYS_2018) -> DataFrame:
    """The calendar as a small DataFrame ``(date, kind)``."""
    rows = [(h, HOLIDAY) for h in holidays] + [(w, WORKDAY) for w in workdays]
    return spark.createDataFrame(rows, "date string, kind string").select(
        F.col("date").cast("date").alias("date"), "kind")

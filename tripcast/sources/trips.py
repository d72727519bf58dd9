"""Trip, split and prediction files (O-01, O-02, O-03, O-06).

Files are plain CSV with a header, read with a fixed schema and
``enforceSchema=False`` so that a header which does not match the schema
fails instead of binding columns by position. Parquet with the same schema
is offered too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripcast.functions.geo import with_geohash
from tripcast.functions.time import day_type, hour_of
from tripcast.schema import prediction_file_schema, prediction_schema, test_schema, train_schema

TIME_READ = "yyyy-MM-dd HH:mm:ss[.SSSSSS]"
TIME_WRITE = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def _schema(kind: str, id_type: T.DataType) -> T.StructType:
    if kind == "train":
        return train_schema(id_type)
    if kind == "test":
        return test_schema(id_type)
    raise ValueError("kind must be 'train' or 'test'")


def read_trips(spark: SparkSession, path: str, kind: str = "train", fmt: str = "csv",
               id_type: T.DataType = T.StringType()) -> DataFrame:
    """Past trips (``kind='train'``) or trips to predict (``'test'``)."""
    schema = _schema(kind, id_type)
    if fmt == "parquet":
        return spark.read.schema(schema).parquet(path)
    return (spark.read.schema(schema).option("header", True).option("enforceSchema", False)
            .option("timestampNTZFormat", TIME_READ).option("mode", "FAILFAST").csv(path))


RECORD = "_bad_record"


def read_trips_quarantined(spark: SparkSession, path: str, kind: str = "train",
                           id_type: T.DataType = T.StringType()) -> tuple[DataFrame, DataFrame]:
    """The rows of trip files that fit the schema, and the others: ``(good,
    bad)`` with ``bad (file, record)``, the raw line of each row that has too
    few or too many fields or a value that is none of its type. The reference
    skips such rows without a trace. A header that does not match still fails."""
    schema = _schema(kind, id_type)
    wide = T.StructType([*schema.fields, T.StructField(RECORD, T.StringType())])
    rows = (spark.read.schema(wide).option("header", True).option("enforceSchema", False).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", RECORD).option("timestampNTZFormat", TIME_READ).csv(path))
    # A row is judged by all of its fields, whatever columns are asked for: the
    # condition always holds, but keeps the reader from leaving any out.
    whole = F.xxhash64(*schema.fieldNames()) >= F.lit(-(1 << 63))
    good = rows.filter(F.col(RECORD).isNull() & whole).select(*schema.fieldNames())
    bad = rows.filter(F.col(RECORD).isNotNull() & whole).select(
        F.col("_metadata.file_path").alias("file"), F.col(RECORD).alias("record"))
    return good, bad


def quarantine_counts(bad: DataFrame) -> DataFrame:
    """Number of rows of each file that did not fit (files without any have no
    row)."""
    return bad.groupBy("file").agg(F.count(F.lit(1)).alias("n_bad"))


def write_trips(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> None:
    w = df.write.mode(mode)
    if fmt == "parquet":
        w.parquet(path)
    else:
        w.option("header", True).option("timestampNTZFormat", TIME_WRITE).csv(path)


def write_split(train: DataFrame, test: DataFrame, path: str, fmt: str = "csv") -> tuple[str, str]:
    """Both halves of a split, ``<path>/train`` and ``<path>/test`` (O-06)."""
    base = path.rstrip("/")
    write_trips(train, f"{base}/train", fmt)
    write_trips(test, f"{base}/test", fmt)
    return f"{base}/train", f"{base}/test"


def write_predictions(pred: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> None:
    """Prediction results of all persons and all k in one write, one folder
    per k (O-03); every file has a header."""
    w = pred.write.mode(mode).partitionBy("k")
    if fmt == "parquet":
        w.parquet(path)
    else:
        w.option("header", True).csv(path)


def read_predictions(spark: SparkSession, path: str, k: int | None = None, fmt: str = "csv",
                     id_type: T.DataType = T.StringType()) -> DataFrame:
    """Prediction results with the partition column ``k`` (O-02); a given k
    prunes the other folders."""
    schema = prediction_schema(id_type)
    if fmt == "parquet":
        df = spark.read.schema(schema).parquet(path)
    else:
        df = (spark.read.schema(schema).option("header", True).option("enforceSchema", False)
              .option("mode", "FAILFAST").csv(path))
    return df if k is None else df.filter(df["k"] == k)


def prediction_file_rows(test: DataFrame, pred: DataFrame) -> DataFrame:
    """Trips to predict with ``period`` (hour), ``week_code`` (day type),
    ``start_code`` (8-character cell of the start), ``predict`` (predicted
    8-character class) and ``k``: the file that the reference's weighted
    predictor appends person by person (O-03). ``pred`` is
    ``knn_sweep(..., with_class=True)``; trips without history are absent."""
    rows = with_geohash(test, "start_lat", "start_lon", "start_code", 8)
    rows = rows.withColumn("period", hour_of("start_time")).withColumn("week_code", day_type("start_time"))
    return rows.join(pred.select("r_key", "k", "predict"), "r_key").select(
        *test.columns, "period", "week_code", "start_code", "predict", "k")


def write_prediction_file(rows: DataFrame, path: str) -> None:
    """One folder per k, replaced as a whole when a k is written again; other
    folders stay."""
    (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("k")
     .option("header", True).option("timestampNTZFormat", TIME_WRITE).csv(path))


def read_prediction_file(spark: SparkSession, path: str, k: int | None = None,
                         id_type: T.DataType = T.StringType()) -> DataFrame:
    df = (spark.read.schema(prediction_file_schema(id_type)).option("header", True).option("enforceSchema", False)
          .option("timestampNTZFormat", TIME_READ).option("mode", "FAILFAST").csv(path))
    return df if k is None else df.filter(df["k"] == k)

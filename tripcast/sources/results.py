"""The result table: one row per stored prediction (O-04, O-05).

Stored as Parquet partitioned by ``type`` and ``k``, so reading one run
prunes every other folder; a JDBC target is written with Spark's own JDBC
writer in batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripcast.schema import result_schema


def write_results(df: DataFrame, target: str, fmt: str = "parquet", mode: str = "run",
                  jdbc_options: dict | None = None) -> None:
    """Store result rows ``(r_key, lat, lon, dis, type, k)``.

    ``mode='run'`` commits whole runs: the folders of the ``(type, k)`` runs
    that occur in ``df`` are replaced when the job succeeds, all others stay,
    so a repeated or retried run leaves its rows once. A run without any row
    replaces nothing. ``'append'`` adds rows as the reference does; JDBC knows
    only that."""
    cols = ["r_key", "lat", "lon", "dis", "type", "k"]
    out = df.select(*cols)
    if fmt == "jdbc":
        opts = {"dbtable": target, "batchsize": "10000", **(jdbc_options or {})}
        out.write.format("jdbc").options(**opts).mode("append" if mode == "run" else mode).save()
        return
    if mode == "run":
        (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("type", "k")
         .parquet(target))
        return
    out.write.mode(mode).partitionBy("type", "k").parquet(target)


def read_results(spark: SparkSession, source: str, k: int | None = None, type_: str | None = None,
                 any_type: bool = False, id_type: T.DataType = T.StringType()) -> DataFrame:
    """Rows of one run: ``k`` equal and ``type`` equal null-safely, so
    ``type_=None`` selects the run stored without a type (O-05)."""
    df = spark.read.schema(result_schema(id_type)).parquet(source)
    if k is not None:
        df = df.filter(F.col("k") == k)
    if not any_type:
        df = df.filter(F.col("type").eqNullSafe(F.lit(type_).cast("string")))
    return df

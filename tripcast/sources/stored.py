"""Feature tables stored by person (O-12, O-29, O-30).

A table bucketed and sorted by ``out_id`` is laid out once; the joins,
aggregations and models per person that read it then need no exchange by
person. The number of buckets is the layout's parallelism: a person lies in one
bucket, so persons that hold a large part of all rows are better served by the
box index, which does not depend on this layout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PERSON = "out_id"


def store_by_person(df: DataFrame, name: str, path: str, buckets: int | None = None, key: str = PERSON) -> DataFrame:
    """Write ``df`` as the external table ``name`` in ``path``, bucketed and
    sorted by the person, and read it back. Both sides of a join need the same
    number of buckets (by default the session's shuffle partitions)."""
    spark: SparkSession = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.sql(f"DROP TABLE IF EXISTS `{name}`")
    (df.repartition(n, key).write.format("parquet").option("path", path).mode("overwrite")
     .bucketBy(n, key).sortBy(key).saveAsTable(name))
    return spark.table(name)

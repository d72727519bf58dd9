"""Connected components of a table of links, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripcast.llm.common import drop_written, written


def components(links: DataFrame) -> DataFrame:
    """``(id, component)`` with the smallest reachable id, for every id of the
    links ``(a, b)``. Alternating large-star and small-star rounds, each a
    grouped minimum and a join, until the links no longer change; a hub's
    links are spread by the join, never gathered in one task."""
    edges = written(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                    .distinct(), "edges")
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.filter("a <> b").distinct(), "edges")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = (joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(low.select("a", F.col("m").alias("b"))))
        new = written(small.filter("a <> b").distinct(), "edges")
        row = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop_written(edges)
        drop_written(large)
        edges = new
        if tuple(row) == mark:
            break
        mark = tuple(row)
    hubs = edges.select(F.col("b").alias("id")).distinct().withColumn("component", F.col("id"))
    return edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component")).unionByName(
        hubs.join(edges.select(F.col("a").alias("id")), "id", "left_anti"))

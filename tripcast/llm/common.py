"""Helpers shared by the operators: inputs, the train/held-out rule, written
intermediate tables and text batches inside tasks.

Rules that hold for every operator: a null text counts as the empty text, a
null ``doc_id`` is a document of its own that takes part in nothing learned,
extra input columns are ignored (each operator selects the columns that it
names), and an empty table gives an empty result with the same schema.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tripcast.session import scratch_path

# A word of the contracts: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

# Bytes of text that one numpy pass inside a task works on.
SLICE_BYTES = 1 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def id_and_text(docs: DataFrame) -> DataFrame:
    """``(doc_id long, text string)`` with null texts as empty texts."""
    # A column that is long already keeps its name without an alias, so that
    # plans that read the table twice can share one exchange.
    doc_id = F.col("doc_id")
    if dict(docs.dtypes)["doc_id"] != "bigint":
        doc_id = doc_id.cast("long").alias("doc_id")
    return docs.select(doc_id, F.coalesce(F.col("text"), F.lit("")).alias("text"))


def held_out(doc_id: Column) -> Column:
    """True for the fourth of the documents that no model learns from; a null
    id is never held out (and never learned from, see the callers)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learnable(doc_id: Column) -> Column:
    return doc_id.isNotNull() & ~held_out(doc_id)


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write the frame as a table in the cluster's shared folder and read it
    back: cuts the lineage and runs the plan once."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_by(df: DataFrame, name: str, key: str, codec: str = "zstd") -> DataFrame:
    """As :func:`written`, in as many buckets of ``key`` as a shuffle has
    partitions: a join by the key with any table moves that table only. The
    catalogue has the table until the frame that reads it is made."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    table = os.path.basename(path).replace("-", "_")
    (df.write.format("parquet").option("compression", codec).option("path", path)
     .bucketBy(partitions(spark), key).saveAsTable(table))
    found = spark.table(table)
    spark.sql(f"DROP TABLE `{table}`")  # the files stay, the path being given
    return found


def drop_written(df: DataFrame) -> None:
    """Delete a table made by :func:`written` that no later plan reads."""
    spark = df.sparkSession
    for f in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/tripcast-scratch/" in f:
            path = spark._jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_slices(batches: Iterable[pa.RecordBatch], limit: int = SLICE_BYTES
                ) -> Iterator[tuple[list, list[bytes]]]:
    """Cut Arrow batches of ``(doc_id, text)`` into slices of about ``limit``
    bytes (a longer text is a slice of its own): ids and UTF-8 texts."""
    ids: list = []
    texts: list[bytes] = []
    size = 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
            t = t or b""
            if ids and size + len(t) > limit:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(i)
            texts.append(t)
            size += len(t)
    if ids:
        yield ids, texts


def package_on_workers(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it (a
    cluster that installs the package or ships it with --py-files needs no
    more)."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))


def with_results(docs: DataFrame, score: Callable[[list], dict[str, pa.Array]], results: str) -> DataFrame:
    """Run ``score`` over the texts of Arrow batches; returns the input's
    columns in a struct ``row`` (so no name can clash) and the result columns
    named in the schema string ``results``."""
    from pyspark.sql.types import StructField, StructType

    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    schema = StructType([packed.schema["row"], *StructType.fromDDL(results).fields])
    text_at = docs.columns.index("text")  # sent once, as a part of the row

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = score([t or "" for t in batch.column(0).field(text_at).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), *made.values()], ["row", *made])

    return packed.mapInArrow(run, StructType([StructField("row", schema[0].dataType), *schema.fields[1:]]))


# Bits of a monotonically increasing id below its partition number.
PLACE_BITS = 33


def laid_out(df: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """The rows in one global order, range-partitioned and written, with
    ``place``: a number that grows with the order (a task's number and the
    row's number in it). Written, so that a recomputed task cannot renumber."""
    spread = df.repartitionByRange(partitions(df.sparkSession), *order).sortWithinPartitions(*order)
    return written(spread.withColumn("place", F.monotonically_increasing_id()), name)


def positions(laid: DataFrame, group: list[str]) -> DataFrame:
    """``pos`` (from 0) and ``n`` of each row of a :func:`laid_out` table
    within its group; the group's columns lead the table's order. No group is
    put into one task: its pieces are shifted by the sizes of earlier pieces,
    a table with one row a group and range partition."""
    piece = F.shiftright("place", PLACE_BITS).alias("piece")
    sizes = laid.groupBy(*group, piece).agg(F.count(F.lit(1)).alias("c"), F.min("place").alias("low"))
    of_group = Window.partitionBy(*group)
    sizes = sizes.select(
        *[F.col(c).alias(f"__{c}") for c in group], "piece", "low",
        (F.sum("c").over(of_group.orderBy("piece")) - F.col("c")).alias("before"), F.sum("c").over(of_group).alias("n"))
    same = F.shiftright("place", PLACE_BITS) == F.col("piece")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return laid.join(sizes, same).select(
        *laid.columns, (F.col("before") + F.col("place") - F.col("low")).alias("pos"), "n")

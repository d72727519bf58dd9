"""Session helpers: a local session for tests and benches, and the shared
scratch folder taken from ``spark.checkpoint.dir``."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "tripcast") -> SparkSession:
    """Local session used by tests and ``bench.py``: UTC, AQE on, UI off."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # small tables with much work a row still use all cores
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        # no Python stack is recorded for every column expression that is built
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", os.environ.get("TRIPCAST_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    An active checkpoint folder is used as is; otherwise
    ``spark.checkpoint.dir`` from the session is applied. Only a local-mode
    session without either gets its own folder; on a cluster that is an
    error, because a machine-local folder would not be visible to the other
    executors.
    """
    sc = spark.sparkContext
    active = sc._jsc.sc().getCheckpointDir()
    if active.isDefined():
        return active.get()
    conf = sc.getConf().get(CHECKPOINT_KEY, None) or spark.conf.get(CHECKPOINT_KEY, None)
    if conf:
        sc.setCheckpointDir(conf)
        return sc._jsc.sc().getCheckpointDir().get()
    if not re.fullmatch(r"local(\[[^\[\]]*\])?", sc.master):  # local-cluster[...] has executors of its own
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a shared folder for this cluster")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="tripcast-ckpt-", dir="/tmp"))
    return sc._jsc.sc().getCheckpointDir().get()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder, for written tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/tripcast-scratch/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to a fresh scratch folder and read back, for a frame
    that several steps read."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def freeze(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared checkpoint folder (reliable, eager):
    used where a frame feeds several jobs or carries partition numbers that
    must not change when a lost task is recomputed."""
    ensure_checkpoint_dir(df.sparkSession)
    # Not persisted first: every frozen frame ends in a shuffle, so the file
    # write after the eager job re-reads shuffle output instead of recomputing
    # the plan, and an in-memory columnar cache costs more than it saves.
    return df.checkpoint(eager=True)

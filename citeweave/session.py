"""Session helpers: a tuned local session for tests/bench and checkpoint handling."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "citeweave") -> SparkSession:
    """Session for tests and the local benchmark (UI off, AQE on, UTC)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("CITEWEAVE_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint directory.

    On a cluster the operator of the cluster names a shared folder in
    ``spark.checkpoint.dir``; we read it and never override it.  Only a ``local``
    master (tests, bench) may leave it unset: it then gets a fresh scratch folder
    that goes with the process.  On any other master an unset folder is an error.
    Files of a shuffle go when the action that made them ends: what is read again is stored as a table.
    """
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    sc = spark.sparkContext
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current:
        return current
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir() or conf_dir
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise RuntimeError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="citeweave-ckpt-")
    atexit.register(shutil.rmtree, local, ignore_errors=True)
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir() or local


def scratch_table_path(spark: SparkSession, name: str) -> str:
    """A unique path under the checkpoint dir for a materialised intermediate table."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/tables/{name}-{uuid.uuid4().hex[:12]}"


# Largest table (estimated bytes) that operators broadcast after counting it.
BROADCAST_BYTES = 64 * 1024 * 1024


def fits_broadcast(n_rows: int, row_bytes: int) -> bool:
    """Size check used before an explicit broadcast: only tables whose counted
    rows times an upper bound of the row width stay under ``BROADCAST_BYTES``."""
    return n_rows * row_bytes <= BROADCAST_BYTES


def tasks_for(spark: SparkSession, rows: int, per_task: int) -> int:
    """Partitions of a shuffle of ``rows`` rows: those of the session, more where a task would get over ``per_task``."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_task))


def materialize(df, name: str = "stage"):
    """Write ``df`` as Parquet under the session's checkpoint folder and read it
    back: one job, columnar, and the lineage is cut (a lost executor re-reads the
    shared files instead of recomputing earlier iterations)."""
    path = scratch_table_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored.stored_at = path
    return stored


def discard(stored) -> None:
    """Deletes a table that ``materialize`` wrote and nothing reads any more."""
    spark = stored.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(stored.stored_at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def fixed_plans(spark: SparkSession):
    """Adaptive execution is off inside: for plans that are to keep a layout, or many small ones whose shuffles all
    have their number of tasks, where planning each stage again takes longer than the stage."""
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def keep_layout(laid):
    """Reliable checkpoint of ``laid`` that keeps its partitioning and order for later joins.  Adaptive execution is off
    while it runs: a plan that may still change tells no layout."""
    ensure_checkpoint_dir(laid.sparkSession)
    with fixed_plans(laid.sparkSession):
        return laid.checkpoint()


class Workspace:
    """Named intermediate tables of one job under the shared checkpoint folder.

    ``keep`` writes a table and reads it back; ``drop`` removes tables that nothing
    reads any more, so a long job holds only its live intermediates on disk."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, scratch_table_path(spark, name)

    def keep(self, df, name: str):
        path = f"{self.base}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

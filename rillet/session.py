"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
from contextlib import contextmanager

from pyspark.sql import SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cores: int = 8, shuffle_partitions: int = 8, app: str = "rillet",
                  driver_memory: str | None = None, extra: dict[str, str] | None = None) -> SparkSession:
    """A local session configured like the cluster one (tests, bench)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    if driver_memory:
        builder = builder.config("spark.driver.memory", driver_memory)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    Taken from ``spark.checkpoint.dir`` when the cluster names one.  Only a
    local-mode session without the setting gets a fresh folder under the
    system temp directory (tests); on a cluster the setting is required,
    because a machine-local folder does not survive the loss of an executor.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect: the server's setting applies
        configured = spark.conf.get(_CHECKPOINT_KEY, None)
        if not configured:
            raise RuntimeError(f"{_CHECKPOINT_KEY} is not set; name a shared folder for checkpoints")
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get(_CHECKPOINT_KEY, None) or sc.getConf().get(_CHECKPOINT_KEY, None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                f"{_CHECKPOINT_KEY} is not set; name a shared folder for checkpoints")
        configured = tempfile.mkdtemp(prefix="rillet-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-path of the shared checkpoint folder for written tables."""
    import uuid

    root = checkpoint_root(spark)
    return os.path.join(root, f"{name}-{uuid.uuid4().hex}")


#: Deletes the shuffle files of a SQL execution when it ends; what a written table needs is in its files.
_CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_cleaned(spark: SparkSession):
    """Within the block, shuffle files go as soon as the write that made them has ended."""
    try:
        before = spark.conf.get(_CLEANUP_KEY)
        spark.conf.set(_CLEANUP_KEY, "true")
    except Exception:  # noqa: BLE001 - a Spark version without the setting
        yield
        return
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP_KEY, before)


def materialize(df, name: str = "table"):
    """Write ``df`` as parquet under the shared checkpoint folder and read it back.

    Cuts the lineage like ``checkpoint()`` (the files survive the loss of
    any executor) but stores columns, so later passes read only the columns
    they use.  The shuffle files of the write are deleted with its end.
    """
    path = scratch_path(df.sparkSession, name)
    with shuffles_cleaned(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

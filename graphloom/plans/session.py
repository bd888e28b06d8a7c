"""Session helpers: local sessions for tests, and the shared checkpoint folder."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str = "8", shuffle_partitions: int = 8, app: str = "graphloom") -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point reliable checkpoints at the folder the cluster names in spark.checkpoint.dir.

    Only where the session names none (local tests) is a folder of our own used; a cluster is
    expected to name one that every executor can reach.
    """
    if spark.sparkContext.getCheckpointDir():
        return
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        spark.sparkContext.setCheckpointDir(given)
        return
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="graphloom-"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder and cut its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files and checkpoints of frames that are no longer referred to; it does so when the driver collects its garbage."""
    gc.collect()
    time.sleep(1.5)  # Py4J tells the driver of it from a thread of its own
    spark.sparkContext._jvm.System.gc()
    time.sleep(0.5)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder path within the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"

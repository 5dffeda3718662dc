"""Session construction and the shared checkpoint folder.

Library functions never create a session themselves; they take the
DataFrames they are given.  ``get_spark`` is for tests, the bench and
command-line use.
"""

from __future__ import annotations

import os
import tempfile

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

# Adaptive execution settings every job here is planned with.  AQE
# coalesces small shuffle partitions, converts joins to broadcast only
# when the runtime size of a side is under the threshold (a checked
# size, not a guess), and splits skewed sort-merge join partitions.
_AQE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Coalescing keeps parallelism first; a small shuffle of long texts
    # (statements after page assembly) still gets several tasks for its
    # CPU-heavy per-row work.  Large shuffles are unaffected.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "256KB",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32MB",
    "spark.sql.autoBroadcastJoinThreshold": "32MB",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(
    master: str | None = None,
    shuffle_partitions: int | None = None,
    app_name: str = "ledgerlens",
    extra_conf: dict | None = None,
) -> SparkSession:
    """Build (or fetch) a session with the settings the library expects.

    Without ``shuffle_partitions`` a cluster keeps its own setting (adaptive
    execution merges small partitions but adds none); a local session takes
    one per core."""
    builder = SparkSession.builder.appName(app_name)
    master = master or os.environ.get("LEDGERLENS_MASTER", "local[8]")
    builder = builder.master(master)
    conf = dict(_AQE_CONF)
    if shuffle_partitions is None and master.startswith("local"):
        shuffle_partitions = int("".join(c for c in master if c.isdigit()) or 8)
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if master.startswith("local"):
        conf["spark.driver.memory"] = os.environ.get("LEDGERLENS_DRIVER_MEMORY", "8g")
    if extra_conf:
        conf.update(extra_conf)
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder of the session.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is
    used as it is.  Only when nothing is configured (local tests) a fresh
    scratch folder is made and registered.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        master = sc.master or ""
        if not master.startswith("local"):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; a cluster needs a shared folder for checkpoints"
            )
        configured = tempfile.mkdtemp(prefix="ledgerlens-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and drop its lineage.

    A reliable checkpoint survives the loss of the executors that
    computed it, unlike cached blocks or local checkpoints.  The frame is
    persisted first: writing an RDD checkpoint is a second job over the
    same partitions, which would otherwise compute the whole lineage
    again.  The cached blocks are dropped once the files are written.
    """
    checkpoint_dir(df.sparkSession)
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return df.checkpoint(eager=True)
    finally:
        df.unpersist()

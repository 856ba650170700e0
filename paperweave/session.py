"""Spark session helpers.

The library never creates a session behind the caller's back: every public
function takes DataFrames (or a session) as arguments. ``local_session`` is
for tests, benchmarks and the driver entry point only.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job of this package relies on. AQE re-plans joins at runtime
# (broadcast only when the measured size is below the threshold, skew splits,
# partition coalescing), so no join in the library hard-codes a strategy for
# tables whose size grows with the data.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    # No broadcast from file-size estimates (a semi-joined fact table can be
    # estimated small); AQE broadcasts on measured sizes, and the library
    # broadcasts seed / query tables only after a row-count check.
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32MB",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # checkpoint files go once nothing refers to their frame any more
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "paperweave") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "16g")
    )
    for k, v in SCALE_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder named by the cluster.

    On a cluster ``spark.checkpoint.dir`` points to shared storage and is used
    as is; unset, it is an error, since other executors can't see a folder of
    this machine. Only a ``local`` master (tests) gets a private folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="pw-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A folder for intermediate tables under the shared checkpoint root."""
    root = ensure_checkpoint_dir(spark)
    return os.path.join(root, "paperweave-tables", name)


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of the JVM, for any scheme that Spark reads."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()), jvm_path


def remove_path(spark: SparkSession, path: str) -> None:
    fs, p = hadoop_path(spark, path)
    fs.delete(p, True)


def staged(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` once as Parquet in the shared scratch folder; the frame
    read back, and its folder for ``remove_path`` when it is no longer needed."""
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as a reliable checkpoint in ``spark.checkpoint.dir``
    and return the checkpointed frame (its plan starts at the files).

    The frame is persisted while the checkpoint is written, so the plan runs
    once (checkpointing an unpersisted plan computes it twice). A lost
    executor afterwards re-reads the checkpoint files instead of recomputing
    the lineage. Never a local checkpoint: those die with the executor.
    """
    ensure_checkpoint_dir(df.sparkSession)
    df.persist()
    try:
        return df.checkpoint(eager=True)
    finally:
        df.unpersist()

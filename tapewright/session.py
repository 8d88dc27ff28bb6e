"""Session settings the package relies on, and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Runtime settings only, so they can be applied to a session someone else built.
REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # A Python worker holds a few batches at once; long texts would make them large.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 * 1024 * 1024),
}

TASK_BYTES = 128 * 1024 * 1024
CHECKPOINT_DIR = "spark.checkpoint.dir"


def build_session(app_name: str = "tapewright", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the required settings. Cluster sizing stays with spark-submit."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**REQUIRED, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def sizing(shuffled_bytes: int, cores: int) -> dict[str, str]:
    """Settings for a job of a known size: about 128 MB per shuffle task, and no fewer than two tasks per core.

    AQE merges what turns out smaller and splits what is skewed, but does not raise the number. The
    default of 200 would give a 100 TB shuffle tasks of half a terabyte.
    """
    tasks = max(2 * cores, -(-shuffled_bytes // TASK_BYTES))
    return {
        "spark.sql.shuffle.partitions": str(tasks),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(TASK_BYTES),
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
        "spark.sql.files.maxPartitionBytes": str(2 * TASK_BYTES),
    }


def configure(spark: SparkSession) -> SparkSession:
    """Apply the required settings to an existing session. Day buckets and zone maths are in UTC."""
    for key, value in REQUIRED.items():
        spark.conf.set(key, value)
    return spark


# Where a local session keeps its scratch tables when it names no folder.
_LOCAL_SCRATCH: list[str] = []


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the cluster's shared checkpoint folder, as the session names it.

    A single-process session (unit tests, a laptop) may leave it unset and gets a temporary folder. On a
    cluster that would be one machine's disk, so there it is an error.
    """
    base = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that the driver and all executors share")
        if not _LOCAL_SCRATCH:
            _LOCAL_SCRATCH.append(tempfile.mkdtemp(prefix="tapewright-"))
        base = _LOCAL_SCRATCH[0]
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"

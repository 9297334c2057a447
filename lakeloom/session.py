"""Session helpers: the shared work folder and a local session for tests."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

_LOCAL_FALLBACK: dict[str, str] = {}
_CONTEXT_DIR_SET: set[str] = set()


def work_root(spark: SparkSession) -> str:
    """Shared folder for landing files, tables and snapshots.

    Read from ``spark.checkpoint.dir`` (the folder the cluster names for
    checkpoints). Only a local session without that setting gets a private
    temporary folder; a cluster without it is a configuration error, because a
    machine-local folder is not visible to executors.
    """
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        # Named only in the session conf: point DataFrame.checkpoint() at the
        # same shared folder (once per application).
        app = spark.sparkContext.applicationId
        if app not in _CONTEXT_DIR_SET:
            spark.sparkContext.setCheckpointDir(root)
            _CONTEXT_DIR_SET.add(app)
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FALLBACK:
        _LOCAL_FALLBACK[app] = tempfile.mkdtemp(prefix="lakeloom-")
        spark.sparkContext.setCheckpointDir(_LOCAL_FALLBACK[app])
    return _LOCAL_FALLBACK[app]


def scratch_dir(spark: SparkSession, kind: str) -> str:
    """A fresh, never-reused folder under the work root."""
    return f"{work_root(spark)}/lakeloom/{kind}/{uuid.uuid4().hex}"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  extra_conf: dict | None = None) -> SparkSession:
    """Session used by tests and the bench (UI off, AQE on, UTC)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lakeloom")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("LAKELOOM_DRIVER_MEMORY", "8g"))
    )
    for k, v in (extra_conf or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scale_conf(input_bytes: int, executors_cores: int, target_partition_bytes: int = 256 << 20) -> dict:
    """Settings for a large cluster run, sized from the input volume.

    Shuffle partitions start at input / target size (AQE coalesces small ones
    and splits skewed ones at runtime), scans use larger splits, and the
    broadcast threshold stays at Spark's checked default so only sides whose
    runtime size is known to be small are broadcast.
    """
    parts = max(2 * executors_cores, input_bytes // target_partition_bytes)
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": str(int(parts)),
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.session.timeZone": "UTC",
    }


def apply_conf(spark: SparkSession, conf: dict) -> None:
    for k, v in conf.items():
        spark.conf.set(k, v)

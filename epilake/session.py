"""Spark session settings and the shared work folder.

Cluster runs pass their own session; these helpers only fill in what is
unset, so a cluster's `spark.checkpoint.dir` and partition sizing win.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job relies on. AQE re-plans joins from runtime sizes,
# coalesces small shuffle partitions and splits skewed join partitions.
SESSION_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "epilake") -> SparkSession:
    """Local/test session. On a cluster use the cluster's session instead."""
    master = master or os.environ.get("EPILAKE_MASTER", "local[8]")
    cores = shuffle_partitions or int(os.environ.get("BENCH_CPUS", "8"))
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    )
    for k, v in SESSION_DEFAULTS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_work_dir(spark)
    return spark


def apply_defaults(spark: SparkSession) -> None:
    """Set the job defaults on a given session, leaving explicit settings alone."""
    for k, v in SESSION_DEFAULTS.items():
        if spark.conf.get(k, None) is None:
            spark.conf.set(k, v)


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def ensure_work_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and written intermediate tables.

    Reads `spark.checkpoint.dir` from the session. Only a local session
    (tests, bench) may get a fresh temporary folder when it is unset; a
    cluster job without a shared folder fails fast instead of writing to
    one machine's disk.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    sc_dir = spark.sparkContext.getCheckpointDir()
    base = conf_dir or sc_dir
    if base is None:
        if not _is_local(spark):
            raise RuntimeError(
                "spark.checkpoint.dir is unset; set it to a shared folder of the cluster")
        base = tempfile.mkdtemp(prefix="epilake-ckpt-")
        spark.conf.set("spark.checkpoint.dir", base)
    if sc_dir is None:
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def work_path(spark: SparkSession, *parts: str) -> str:
    """A path under the shared work folder (URI-safe join)."""
    base = ensure_work_dir(spark)
    return "/".join([base, *parts])


# Target bytes per task for scans and shuffles on a cluster: large enough to keep
# task overhead low, small enough that a sort or hash aggregate of one partition
# fits in an executor core's share of memory and spills little.
TARGET_PARTITION_BYTES = 256 * 1024 * 1024


def cluster_settings(input_bytes: int, shuffle_expansion: float = 1.0,
                     target_bytes: int = TARGET_PARTITION_BYTES) -> dict[str, str]:
    """Partition sizing for a job reading `input_bytes` (compressed Parquet).

    Shuffle partitions ~ shuffled bytes / target, at least 200; AQE then
    coalesces small partitions to the advisory size and splits skewed ones,
    so the number is an upper bound, not a guess to get exactly right.
    """
    shuffled = input_bytes * shuffle_expansion
    parts = max(200, -(-int(shuffled) // target_bytes))
    mb = f"{target_bytes // (1024 * 1024)}m"
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": mb,
        "spark.sql.files.maxPartitionBytes": mb,
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * target_bytes),
    }


def configure_for_input(spark: SparkSession, input_bytes: int, shuffle_expansion: float = 1.0) -> None:
    for k, v in cluster_settings(input_bytes, shuffle_expansion).items():
        spark.conf.set(k, v)

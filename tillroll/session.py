"""Session settings shared by tests, bench and the examples.

Library operators never change session settings; they only read them. The
builder below is for callers that own the session (tests, ``bench.py``).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every operator is written against. AQE re-plans joins from runtime
# sizes (a shuffled side that turns out small becomes a broadcast join), splits
# skewed join partitions and coalesces small shuffle partitions.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.inferTimestampNTZ.enabled": "true",
    "spark.sql.variant.allowDuplicateKeys": "true",      # as a browser reads JSON: the last value counts
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "tillroll", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "8g")
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used
    as is. Only when it is unset and the master is ``local`` (tests) is a
    fresh scratch folder created under ``$TILLROLL_SCRATCH`` or the system
    temp dir; on any other master an unset folder is an error, because a
    machine-local folder is not seen by the other executors.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    base = os.environ.get("TILLROLL_SCRATCH") or tempfile.gettempdir()
    path = tempfile.mkdtemp(prefix="tillroll-ckpt-", dir=base)
    sc.setCheckpointDir(path)
    return path


def cluster_conf(input_bytes: int, executors: int, cores_per_executor: int = 4) -> dict[str, str]:
    """Settings to build a cluster session with, sized from the input.

    * about 256 MB of input per initial shuffle partition, at least two per
      core, so a partition fits an executor core's memory share without
      spilling, and AQE coalesces small ones after the map side;
    * AQE's advisory size at 256 MB and skew handling on: a join partition
      over 5x the median and 512 MB is split;
    * files read in 256 MB splits.

    Operators never set these themselves; callers pass them to
    ``build_session(extra=...)`` or their own builder.
    """
    cores = max(1, executors * cores_per_executor)
    partitions = max(2 * cores, -(-input_bytes // (256 << 20)))
    return {
        "spark.sql.shuffle.partitions": str(min(partitions, 1_000_000)),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 << 20),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(512 << 20),
        "spark.sql.files.maxPartitionBytes": str(256 << 20),
    }

"""Session helpers.

Cluster settings (partition counts, checkpoint folder, memory) belong to the
cluster; these helpers only fill in what is missing so that tests and the
local bench run with sane values.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings every job here relies on. UTC keeps epoch conversions identical to
# the DuckDB oracle. (The fold's shuffle by symbol has a fixed count, see match.)
_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app_name: str = "crossbook") -> SparkSession:
    """A local session for tests and the bench (UI off, UTC, AQE on)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("CROSSBOOK_DRIVER_MEMORY", "8g"))
    )
    for key, value in _DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder, creating a scratch one only if unset.

    On a cluster ``spark.checkpoint.dir`` names a shared folder (HDFS, S3, ...)
    and is used as is. Only on a local master without that setting (tests) a
    fresh scratch folder is taken; elsewhere its absence is an error.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir() or conf_dir
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    scratch = tempfile.mkdtemp(prefix="crossbook-ckpt-", dir="/tmp")
    sc.setCheckpointDir(scratch)
    return sc.getCheckpointDir() or scratch


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Materialise ``df`` into the session's checkpoint folder (eager) and
    return a DataFrame reading it: lineage is cut, so a lost executor never
    re-runs what came before."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)

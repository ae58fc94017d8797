"""Session helpers."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.storagelevel import StorageLevel


def local_session(name: str = "vistagrid", cpus: str | None = None) -> SparkSession:
    """Local session for tests and the bench; a cluster supplies its own."""
    n = cpus or os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{n}]").appName(name)
             .config("spark.sql.shuffle.partitions", "8").config("spark.sql.adaptive.enabled", "true")
             .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
             .config("spark.driver.memory", os.environ.get("VISTAGRID_DRIVER_MEMORY", "8g"))
             .config("spark.sql.execution.arrow.pyspark.enabled", "true")
             .config("spark.log.level", "ERROR").getOrCreate())
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder named by the cluster; only a bare local session falls back to a temporary one."""
    given = spark.conf.get("spark.checkpoint.dir", "") or (spark.sparkContext.getCheckpointDir() or "")
    if given:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(given)
        return given
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a shared folder")
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared(df: DataFrame) -> DataFrame:
    """Marks a result that several branches of one plan read, so it is computed once.

    Blocks go to memory and disk; those of a lost executor are recomputed from their lineage.
    """
    return df.persist(StorageLevel.MEMORY_AND_DISK)

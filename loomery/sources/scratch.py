"""The folder that driver and executors share, and tables fixed in it."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in local mode, where none is set, a fresh folder. A cluster must name one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="loomery-shared-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def fixed(df: DataFrame) -> DataFrame:
    """df written by a reliable checkpoint: the same rows in the same partitions however often it is read."""
    shared_root(df.sparkSession)
    return df.checkpoint()

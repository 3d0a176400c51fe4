"""Helpers that the operators of this subpackage share: the shared folder, file access, free column names."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ARROW_ROWS, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000
LOWER_FROM = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER_TO = "abcdefghijklmnopqrstuvwxyz"


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; in local mode, where none is set, a fresh one.

    A cluster must name one: a folder of the driver's machine would be seen by no executor.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="loomery-shared-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A path of its own below the shared folder, for one run of one operator."""
    return f"{shared_root(spark)}/loomery/{label}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the shared folder."""
    shared_root(df.sparkSession)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files and checkpoints of plans that nothing refers to any more.

    The cleaner acts when the driver's garbage is collected, which a job of few large steps may not see for long.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def written(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again; it survives the loss of any executor."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    release(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables that an operator writes on its way, deleted when its last one is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def written(self, df: DataFrame, label: str) -> DataFrame:
        self.paths.append(scratch(self.spark, label))
        df.write.parquet(self.paths[-1])
        release(self.spark)
        return self.spark.read.schema(df.schema).parquet(self.paths[-1])

    def last(self, df: DataFrame, label: str, clear: bool = True) -> DataFrame:
        """df written and read again; it stays, and what was written before goes if clear."""
        out = written(df, label)
        if clear:
            self.clear()
        return out

    def clear(self) -> None:
        for path in self.paths:
            fs, folder = file_system(path)
            fs.delete_dir(folder)
        self.paths = []


def trim() -> None:
    """Returns the free parts of a worker's heap to the system; the allocator would keep them for as long as the worker lives."""
    import ctypes

    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def give_back() -> None:
    """Returns all that a worker process has freed."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim()


def small_batches() -> None:
    """Sends texts to Python BATCH_ROWS at a time, where the session has Spark's default of 10,000: rows may be long."""
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.conf.get(ARROW_ROWS) == "10000":
        spark.conf.set(ARROW_ROWS, str(BATCH_ROWS))


def lean(run):
    """A function for mapInArrow that gets small batches and gives memory back when its task is done."""
    small_batches()

    def ended(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return ended


def free_name(df: DataFrame, base: str) -> str:
    """A column name that df does not use, whatever its case."""
    used = {c.lower() for c in df.columns}
    name = base
    while name.lower() in used:
        name = f"_{name}"
    return name


def quoted(name: str) -> str:
    """A column name as an unambiguous reference, dots and all."""
    return "`" + name.replace("`", "``") + "`"


def file_system(uri: str):
    """(Arrow file system, path) of a shared folder; works alike on the driver and on executors."""
    from pyarrow import fs

    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[len("file:"):]
    return fs.FileSystem.from_uri(uri)


def partitions_for(spark: SparkSession, factor: int = 1) -> int:
    """The session's shuffle partition count, times factor."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) * factor)

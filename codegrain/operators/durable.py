"""Cutting lineage with tables written to a folder that all executors share.

The folder is the one the cluster names in ``spark.checkpoint.dir``; only where that is unset and driver and
executors are one process, as in tests, a local temporary folder is used, else there is an error.  Tables live until the application ends (or until they are
dropped by name), because lazily evaluated results may still read them.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="codegrain-"))
        atexit.register(_remove_own)
    return _own[0]


def _remove_own() -> None:
    import shutil

    for path in _own:
        shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


def _delete(spark: SparkSession, path: str, at_exit: bool = False) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.deleteOnExit(at) if at_exit else fs.delete(at, True)


def write_table(df: DataFrame, name: str) -> str:
    """Write ``df`` once to the shared folder and return the path."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _delete(df.sparkSession, path, at_exit=True)
    return path


def durable(df: DataFrame, name: str) -> DataFrame:
    """``df``, computed once and read back from the shared folder: its lineage ends there."""
    path = write_table(df, name)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Durable tables that an iteration replaces: the one before is deleted when a new one stands."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.paths = spark, name, []

    def put(self, df: DataFrame, keep: int = 1) -> DataFrame:
        path = write_table(df, self.name)
        self.paths.append(path)
        while len(self.paths) > keep:
            _delete(self.spark, self.paths.pop(0))
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        while self.paths:
            _delete(self.spark, self.paths.pop())

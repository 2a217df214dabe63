"""Intermediate tables: written once where driver and executors share a folder, read as often as needed.

All of an application's tables lie in one folder, which goes when the application ends; ``forget`` removes one earlier.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

#: Whether a query's shuffle files go when it ends, instead of when the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Folders that go when this process's application ends.
_folders: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """A new folder name below ``spark.checkpoint.dir``, which driver and executors share.

    Where the setting is missing, a local master (tests) gets a temporary folder, a cluster the warehouse, which it shares.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and spark.sparkContext.master.split("[")[0] != "local":
        base = spark.conf.get("spark.sql.warehouse.dir")
    if not base:
        base = tempfile.mkdtemp(prefix="verdikt-")
        spark.sparkContext.setCheckpointDir(base)
        base = spark.sparkContext.getCheckpointDir() or base
    own = f"{base.rstrip('/')}/verdikt-{spark.sparkContext.applicationId}"
    if own not in _folders:
        path, system = _path(spark, own)
        system.mkdirs(path)
        system.deleteOnExit(path)
        _folders.add(own)
    return f"{own}/{uuid.uuid4().hex}"


def _path(spark: SparkSession, name: str) -> tuple:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again: lineage is cut, lost executors lose nothing."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Remove the files of stored tables that nothing reads any more."""
    for df in tables:
        path, system = _path(df.sparkSession, df.stored_at)
        system.delete(path, True)


def frees_shuffles(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``operator`` (a function of a table first) whose stored tables free their shuffle files as soon as each is written."""

    @wraps(operator)
    def run(df: DataFrame, *args, **kwargs) -> DataFrame:
        conf = df.sparkSession.conf
        before = conf.get(CLEANUP, None)
        conf.set(CLEANUP, "true")
        try:
            return operator(df, *args, **kwargs)
        finally:
            conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)

    return run

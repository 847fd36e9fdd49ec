"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_local = threading.local()
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset, a temporary one if all tasks run in this process, else an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.conf.get("spark.master", "").split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="voxelith-")
    return _own[app]


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts the lineage, survives lost executors.

    The shuffle files behind it go once it is written, as nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    _tables().append(path)
    return spark.read.schema(df.schema).parquet(path)


def _tables() -> list[str]:
    """The tables that this thread has stored and not deleted."""
    if not hasattr(_local, "tables"):
        _local.tables = []
    return _local.tables


def mark() -> int:
    """A point in this thread's sequence of stored tables, for ``drop_since``."""
    return len(_tables())


def drop_since(spark: SparkSession, point: int, keep: int = 0) -> None:
    """Delete the tables stored since ``point``, but for the last ``keep``; nothing may read them any more."""
    tables = _tables()
    end = len(tables) - keep
    for path in tables[point:end]:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    del tables[point:end]

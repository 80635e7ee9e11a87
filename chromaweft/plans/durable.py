"""Intermediate tables that outlive executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, SparkSession] = {}
_path_of: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def shared_root(spark: SparkSession) -> str:
    """The folder the cluster shares (spark.checkpoint.dir); a temporary one of our own only where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        global _own
        _own = _own or tempfile.mkdtemp(prefix="chromaweft-")
        found = _own
    return found.rstrip("/")


_own: str | None = None


def scratch_path(spark: SparkSession, name: str = "table") -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_root(spark)}/chromaweft-{name}-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def durable(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back."""
    spark = df.sparkSession
    path = scratch_path(spark)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    _path_of[back] = path
    return back


def discard(df: DataFrame) -> None:
    """Delete a table that durable wrote, once all that was computed from it is written."""
    path = _path_of.pop(df)
    delete(df.sparkSession, path)
    _written.pop(path, None)


def _clean() -> None:
    for path, spark in _written.items():
        try:
            delete(spark, path)
        except Exception:  # the session has ended; the folder's owner cleans up
            return


atexit.register(_clean)

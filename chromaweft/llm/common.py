"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; one of our own only where none is set (tests on one machine)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jvm_dir.isDefined():
            found = jvm_dir.get()
        else:
            found = tempfile.mkdtemp(prefix="chromaweft-")
            spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


_written: list[tuple[SparkSession, str]] = []
_path_of: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _clean() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session has ended; the folder's owner cleans up
            return


atexit.register(_clean)


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/chromaweft/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, and any executor may be lost afterwards."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    _path_of[back] = path
    return back


def discard(df: DataFrame) -> None:
    """Delete a table that materialize wrote, once all that was computed from it is written."""
    remove(df.sparkSession, _path_of.pop(df))


def remove(spark: SparkSession, path: str) -> None:
    """Delete what was written to a scratch_path."""
    _delete(spark, path)
    _written[:] = [x for x in _written if x[1] != path]


def crc_mod(column: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null ids give null."""
    return F.crc32(column.cast("string").cast("binary")) % modulus


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hash_fraction(*columns: Column) -> Column:
    """A number in [0, 1) that depends on the columns alone."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) / float(1 << 30)


def stratified_sample(df: DataFrame, stratum: str, key: str, per_stratum: int) -> DataFrame:
    """About per_stratum rows of each stratum, chosen by a hash of the key: repeatable, no sort, no shuffle of rows.

    Strata are few (labels, languages): their sizes go through the driver.
    """
    sizes = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("n")).collect()
    share = F.lit(0.0)
    for value, n in sizes:
        share = F.when(F.col(stratum).eqNullSafe(F.lit(value)), F.lit(per_stratum / n)).otherwise(share)
    return df.filter(hash_fraction(F.col(key)) < share)

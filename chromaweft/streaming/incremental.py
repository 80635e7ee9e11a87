"""Bin-pair counts of a growing pair store, kept up to date by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_store(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """New files of a store as they come; the schema is that of the files already there."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def streaming_counts(pairs: DataFrame, bins: DataFrame) -> DataFrame:
    """a1, a2, lib, count: a static join with the bins (frag_id, bin), then one keyed state per bin pair and library."""
    look = bins.select("frag_id", "bin")
    out = pairs.join(look.toDF("anchor1_id", "a1"), "anchor1_id").join(look.toDF("anchor2_id", "a2"), "anchor2_id")
    return out.groupBy("a1", "a2", "lib").agg(F.count(F.lit(1)).alias("count"))


def run_to_table(counts: DataFrame, table: str, checkpoint: str):
    """Process what is there, then stop; call again for what came since."""
    return counts.writeStream.outputMode("complete").format("memory").queryName(table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_store(pairs: DataFrame, bins: DataFrame, path: str, checkpoint: str):
    """Process what is there, then stop: every batch's counts are a table of their own at `path`, so no state grows with the store.

    A batch that is run again after a crash replaces its own table.
    """
    def write(batch: DataFrame, number: int) -> None:
        streaming_counts(batch, bins).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return pairs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored_counts(spark: SparkSession, path: str) -> DataFrame:
    """a1, a2, lib, count over all batches so far."""
    return spark.read.parquet(path).groupBy("a1", "a2", "lib").agg(F.sum("count").alias("count"))

"""The pair store: a Parquet table of read pairs, partitioned by library and chromosome pair."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chromaweft.operators.scan import ORDER, STORED, prune_pairs
from chromaweft.plans.durable import durable
from chromaweft.plans.param import PairParam

PARTITIONS = ["lib", "chr1", "chr2"]
OLD_NAMES = {"anchor": "anchor1", "target": "anchor2"}


def modern_names(pairs: DataFrame) -> DataFrame:
    """anchor.* and target.* columns of older files as anchor1_* and anchor2_*."""
    for c in pairs.columns:
        head, _, tail = c.replace(".", "_").partition("_")
        if head in OLD_NAMES:
            pairs = pairs.withColumnRenamed(c, f"{OLD_NAMES[head]}_{tail}")
    return pairs


def order_ends(pairs: DataFrame, chromosomes: DataFrame | None = None) -> DataFrame:
    """The later end first. Where ids are the wrong way round, every column named with 1 swaps with its twin named with 2.

    Without fragments (chromosomes: chr, chr_idx) chromosome, then position decide, and ids are stored as 0.
    """
    if chromosomes is not None:
        c = chromosomes.select("chr", "chr_idx")
        pairs = pairs.join(c.toDF("chr1", "__i1"), "chr1").join(c.toDF("chr2", "__i2"), "chr2")
        wrong = (F.col("__i2") > F.col("__i1")) | ((F.col("__i2") == F.col("__i1")) & (F.col("anchor2_pos") > F.col("anchor1_pos")))
        pairs = pairs.withColumn("anchor1_id", F.lit(0)).withColumn("anchor2_id", F.lit(0))
    else:
        wrong = F.col("anchor2_id") > F.col("anchor1_id")
    names = [c for c in pairs.columns if not c.startswith("__i")]
    twin = {c: c.replace("1", "2", 1) if "1" in c else c.replace("2", "1", 1) for c in names}
    out = []
    for c in names:
        swap = twin[c] != c and twin[c] in names
        out.append(F.when(wrong, F.col(twin[c])).otherwise(F.col(c)).alias(c) if swap else F.col(c))
    return pairs.select(*out)


def save_pairs(pairs: DataFrame, path: str, chromosomes: DataFrame | None = None, mode: str = "error") -> None:
    """Order each pair's ends and write; rows of a file are in the stored order."""
    if any(c.split("_")[0].split(".")[0] in OLD_NAMES for c in pairs.columns):
        raise ValueError("columns have names of the older format; see modern_names")
    ordered = order_ends(pairs, chromosomes)
    # rows of a chromosome pair are spread over files by their first end, so that a busy pair is no single task
    spread = ordered.repartition(*PARTITIONS, F.floor(F.col("anchor1_pos") / (1 << 22)))
    spread.sortWithinPartitions(*PARTITIONS, "anchor1_id", "anchor2_id", *ORDER).write.mode(mode).partitionBy(*PARTITIONS).parquet(path)


def load_store(spark: SparkSession, path: str, columns: tuple[str, ...] | None = None) -> DataFrame:
    out = modern_names(spark.read.parquet(path))
    return out if columns is None else out.select(*PARTITIONS, *columns)


def check_order(spark: SparkSession, path: str) -> DataFrame:
    """lib, chr1, chr2, n_pairs, out_of_order: rows that stand behind a larger one in their file, in the store's order."""
    rows = spark.read.parquet(path).select(*PARTITIONS, F.struct("anchor1_id", "anchor2_id", *ORDER).alias("at"), F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("row"))
    before = F.lag("at").over(Window.partitionBy("file").orderBy("row"))
    return rows.withColumn("wrong", F.coalesce(before > F.col("at"), F.lit(False))).groupBy(*PARTITIONS).agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if("wrong").alias("out_of_order"))


def chromosome_pairs(store: DataFrame) -> DataFrame:
    return store.select("chr1", "chr2").distinct()


def load_pair(store: DataFrame, first: str, second: str) -> tuple[DataFrame, bool]:
    """(pairs of two chromosomes, whether they are stored the other way round); an error if there are none."""
    for a, b in ((first, second), (second, first)):
        part = store.filter((F.col("chr1") == a) & (F.col("chr2") == b))
        if part.take(1):
            return part, (a, b) != (first, second)
    raise ValueError(f"no pairs between {first} and {second}")


def _replace(spark: SparkSession, fresh: str, path: str) -> None:
    """Put fresh in the place of path. What was there is moved aside first and deleted last, so that a crash loses nothing."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    aside = f"{path.rstrip('/')}-old-{uuid.uuid4().hex}"
    there = files.exists(hadoop(path))
    if there and not files.rename(hadoop(path), hadoop(aside)):
        raise OSError(f"cannot move {path} aside")
    if not files.rename(hadoop(fresh), hadoop(path)):
        if there:
            files.rename(hadoop(aside), hadoop(path))
        raise OSError(f"cannot rename {fresh} to {path}")
    if there:
        files.delete(hadoop(aside), True)


def merge_stores(spark: SparkSession, paths: list[str], path: str) -> None:
    """All pairs of several stores. The result may replace one of them: it is written elsewhere, then renamed."""
    parts = [load_store(spark, p) for p in paths]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p, allowMissingColumns=True)
    fresh = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    save_pairs(whole.select(*PARTITIONS, *STORED, *[c for c in whole.columns if c not in (*PARTITIONS, *STORED)]), fresh)
    _replace(spark, fresh, path)


def prune_store(spark: SparkSession, path: str, param: PairParam, out: str | None = None, max_frag: int | None = None, min_inward: int | None = None, min_outward: int | None = None) -> DataFrame:
    """Write the pairs that pass prune_pairs as a store at `out` (at the same path, if none is given); the totals, one row."""
    kept, totals = prune_pairs(load_store(spark, path), param, max_frag, min_inward, min_outward)
    totals = durable(totals)
    fresh = f"{(out or path).rstrip('/')}-{uuid.uuid4().hex}"
    save_pairs(kept, fresh, param.chromosomes if param.dnase else None)
    _replace(spark, fresh, out or path)
    return totals

"""The driver's order tables read as interaction data, and the same as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from chromaweft.plans.param import PairParam


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Restriction fragments from part: four chromosomes of consecutive fragments."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size")
    n = part.count()
    chr_idx = F.floor(F.col("p_partkey") * 4 / n).cast("int")
    end = F.sum("width").over(Window.partitionBy("chr_idx").orderBy("p_partkey"))
    out = part.withColumn("chr_idx", chr_idx).withColumn("width", (500 + 30 * F.col("p_size")).cast("int")).withColumn("end", end.cast("int"))
    return out.select(
        (F.col("p_partkey") + 1).cast("int").alias("frag_id"),
        F.concat(F.lit("chr"), (F.col("chr_idx") + 1).cast("string")).alias("chr"),
        "chr_idx",
        (F.col("end") - F.col("width") + 1).cast("int").alias("start"),
        "end",
    )


def pairs(spark: SparkSession, sf_dir: str, near: bool = False) -> DataFrame:
    """Read pairs from lineitem; near: most lie close to the diagonal."""
    frag = fragments(spark, sf_dir)
    n = frag.count()
    key, order = F.col("l_partkey").cast("long"), F.col("l_orderkey").cast("long")
    j = F.pmod(key + F.pmod(order * order, F.lit(40)), F.lit(n)) + 1 if near else F.pmod(order, F.lit(n)) + 1
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.col("l_returnflag").alias("lib"),
        F.greatest(key + 1, j).cast("int").alias("anchor1_id"),
        F.least(key + 1, j).cast("int").alias("anchor2_id"),
        F.pmod(F.col("l_suppkey").cast("long"), F.lit(50)).cast("int").alias("o1"),
        F.pmod(order, F.lit(50)).cast("int").alias("o2"),
        F.when(F.col("l_linestatus") == "O", 10).otherwise(-10).alias("anchor1_len"),
        F.when(F.col("l_linenumber") % 2 == 0, 10).otherwise(-10).alias("anchor2_len"),
    )
    one = frag.select(F.col("frag_id").alias("anchor1_id"), F.col("chr").alias("chr1"), F.col("start").alias("s1"))
    two = frag.select(F.col("frag_id").alias("anchor2_id"), F.col("chr").alias("chr2"), F.col("start").alias("s2"))
    out = line.join(one, "anchor1_id").join(two, "anchor2_id")
    return out.select("lib", "chr1", "chr2", "anchor1_id", "anchor2_id", (F.col("s1") + F.col("o1")).alias("anchor1_pos"), (F.col("s2") + F.col("o2")).alias("anchor2_pos"), "anchor1_len", "anchor2_len")


def param(spark: SparkSession, sf_dir: str, **more) -> PairParam:
    return PairParam(fragments=fragments(spark, sf_dir), **more)


#: Bin width of the queries, in base pairs, whatever the tables' size.
WIDTH = 50_000

LIBRARIES = ("A", "N", "R")

#: n.n parts; frag; pairs; near pairs (as above)
SQL = """
n AS (SELECT count(*) AS n, 50000 AS width FROM part),
frag0 AS (SELECT CAST(p_partkey + 1 AS INT) AS frag_id, CAST(floor(p_partkey * 4 / (SELECT n FROM n)) AS INT) AS chr_idx, 500 + 30 * p_size AS w FROM part),
frag AS (SELECT frag_id, 'chr' || (chr_idx + 1) AS chr, chr_idx, CAST(sum(w) OVER (PARTITION BY chr_idx ORDER BY frag_id) - w + 1 AS INT) AS s, CAST(sum(w) OVER (PARTITION BY chr_idx ORDER BY frag_id) AS INT) AS e FROM frag0),
line AS (SELECT l_returnflag AS lib, CAST(l_partkey AS BIGINT) + 1 AS i, CAST(l_orderkey AS BIGINT) % (SELECT n FROM n) + 1 AS j,
  (CAST(l_partkey AS BIGINT) + (CAST(l_orderkey AS BIGINT) * l_orderkey) % 40) % (SELECT n FROM n) + 1 AS jn, l_suppkey % 50 AS o1, l_orderkey % 50 AS o2,
  CASE WHEN l_linestatus = 'O' THEN 10 ELSE -10 END AS len1, CASE WHEN l_linenumber % 2 = 0 THEN 10 ELSE -10 END AS len2 FROM lineitem),
pairs AS (SELECT lib, a.chr AS chr1, b.chr AS chr2, greatest(i, j) AS id1, least(i, j) AS id2, a.s + o1 AS pos1, b.s + o2 AS pos2, len1, len2 FROM line JOIN frag a ON a.frag_id = greatest(i, j) JOIN frag b ON b.frag_id = least(i, j)),
near AS (SELECT lib, a.chr AS chr1, b.chr AS chr2, greatest(i, jn) AS id1, least(i, jn) AS id2, a.s + o1 AS pos1, b.s + o2 AS pos2, len1, len2 FROM line JOIN frag a ON a.frag_id = greatest(i, jn) JOIN frag b ON b.frag_id = least(i, jn)),
bin0 AS (SELECT frag_id, chr, chr_idx, s, e, CAST(floor(((s + e) / 2.0 - 0.1) / (SELECT width FROM n)) AS BIGINT) AS raw FROM frag),
bin AS (SELECT *, dense_rank() OVER (ORDER BY chr_idx, raw) AS bin FROM bin0),
reg AS (SELECT bin AS region_id, min(chr) AS chr, min(chr_idx) AS chr_idx, min(s) AS s, max(e) AS e, count(*) AS nfrags FROM bin GROUP BY bin)
"""

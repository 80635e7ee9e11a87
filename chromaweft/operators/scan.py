"""The scan of a pair table: restrict, discard, cap, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chromaweft.functions.interval import BUCKET, merge_ranges
from chromaweft.plans.param import PairParam

ENDS = ("id", "pos", "len")
STORED = ("anchor1_id", "anchor2_id", "anchor1_pos", "anchor2_pos", "anchor1_len", "anchor2_len")
ORDER = ("anchor1_pos", "anchor2_pos", "anchor1_len", "anchor2_len")


def restrict_pairs(pairs: DataFrame, restrict: tuple) -> DataFrame:
    """Names: both ends on one of them. Pairs of names: the chromosome pair, either way round."""
    if not restrict:
        return pairs
    if isinstance(restrict[0], str):
        return pairs.filter(F.col("chr1").isin(*restrict) & F.col("chr2").isin(*restrict))
    wanted = F.lit(False)
    for a, b in restrict:
        wanted = wanted | ((F.col("chr1") == a) & (F.col("chr2") == b)) | ((F.col("chr1") == b) & (F.col("chr2") == a))
    return pairs.filter(wanted)


def _drop_inside(pairs: DataFrame, ranges: DataFrame, end: str) -> DataFrame:
    """Anti join: the read of this end lies within a merged range. Both sides meet on chromosome and bucket of the read's start."""
    pos, length = F.col(f"anchor{end}_pos"), F.abs(F.col(f"anchor{end}_len"))
    on = (F.col(f"chr{end}") == F.col("__chr")) & (F.floor(pos / BUCKET) == F.col("__bucket")) & (pos >= F.col("__start")) & (pos + length - 1 <= F.col("__end"))
    return pairs.join(ranges, on, "left_anti")


def discard_pairs(pairs: DataFrame, discard: DataFrame | None) -> DataFrame:
    """Drop pairs with a read that lies wholly in a discarded range (ranges that overlap or abut count as one)."""
    if discard is None:
        return pairs
    ranges = merge_ranges(discard).select(
        F.col("chr").alias("__chr"),
        F.col("start").alias("__start"),
        F.col("end").alias("__end"),
        F.explode(F.sequence(F.floor(F.col("start") / BUCKET), F.floor(F.col("end") / BUCKET))).alias("__bucket"),
    )
    return _drop_inside(_drop_inside(pairs, ranges, "1"), ranges, "2")


def cap_pairs(pairs: DataFrame, cap: int | None) -> DataFrame:
    """The first `cap` pairs of two fragments, in stored order."""
    if not cap:
        return pairs
    order = Window.partitionBy("lib", "anchor1_id", "anchor2_id").orderBy(*ORDER)
    return pairs.withColumn("__rank", F.row_number().over(order)).filter(F.col("__rank") <= cap).drop("__rank")


def scan(pairs: DataFrame, param: PairParam, columns: tuple[str, ...] | None = None, capped: bool = True) -> DataFrame:
    """Pairs as the parameters let them through. Filters stand on the scan's own columns, so Parquet sees them."""
    out = discard_pairs(restrict_pairs(pairs, param.restrict), param.discard)
    if capped and not param.dnase:
        out = cap_pairs(out, param.cap)
    return out if columns is None else out.select("lib", "chr1", "chr2", *columns)


def check_pairs(pairs: DataFrame, fragments: DataFrame) -> DataFrame:
    """One row of violations: ends in the wrong order, ids of no fragment, ids on another chromosome, chromosomes without fragments."""
    one = fragments.select(F.col("frag_id").alias("f1"), F.col("chr").alias("c1"))
    two = fragments.select(F.col("frag_id").alias("f2"), F.col("chr").alias("c2"))
    names = fragments.select("chr").distinct()
    both = pairs.join(one, F.col("anchor1_id") == F.col("f1"), "left").join(two, F.col("anchor2_id") == F.col("f2"), "left")
    both = both.join(names.toDF("n1"), F.col("chr1") == F.col("n1"), "left").join(names.toDF("n2"), F.col("chr2") == F.col("n2"), "left")
    return both.agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.count_if(F.col("anchor1_id") < F.col("anchor2_id")).alias("wrong_order"),
        F.count_if(F.col("f1").isNull() | F.col("f2").isNull()).alias("unknown_fragment"),
        F.count_if((F.col("c1") != F.col("chr1")) | (F.col("c2") != F.col("chr2"))).alias("wrong_chromosome"),
        F.count_if(F.col("n1").isNull() | F.col("n2").isNull()).alias("unknown_chromosome"),
    )


def pair_statistics(pairs: DataFrame, fragments: DataFrame | None) -> DataFrame:
    """Adds length, orientation (bit 0: first end reverse, bit 1: second) and insert; null where undefined."""
    p1, p2, l1, l2 = (F.col(f"anchor{i}_{x}") for x in ("pos", "len") for i in (1, 2))
    orientation = F.when(l1 < 0, 1).otherwise(0) + F.when(l2 < 0, 2).otherwise(0)
    insert = F.when(F.col("chr1") == F.col("chr2"), F.greatest(p1 + F.abs(l1), p2 + F.abs(l2)) - F.least(p1, p2))
    if fragments is None:
        return pairs.withColumn("length", F.lit(None).cast("int")).withColumn("orientation", orientation).withColumn("insert", insert)

    def part(pos, length, start, end):
        return F.when(length < 0, pos - length - F.col(start)).otherwise(F.col(end) - pos + 1)

    one = fragments.select(F.col("frag_id").alias("__f1"), F.col("start").alias("__s1"), F.col("end").alias("__e1"))
    two = fragments.select(F.col("frag_id").alias("__f2"), F.col("start").alias("__s2"), F.col("end").alias("__e2"))
    joined = pairs.join(one, F.col("anchor1_id") == F.col("__f1"), "left").join(two, F.col("anchor2_id") == F.col("__f2"), "left")
    total = F.when((F.col("anchor1_id") > 0) & (F.col("anchor2_id") > 0), part(p1, l1, "__s1", "__e1") + part(p2, l2, "__s2", "__e2"))
    return joined.withColumn("length", total).withColumn("orientation", orientation).withColumn("insert", insert).drop("__f1", "__f2", "__s1", "__s2", "__e1", "__e2")


def prune_pairs(pairs: DataFrame, param: PairParam, max_frag: int | None = None, min_inward: int | None = None, min_outward: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(pairs that stay, one row of total, length, inward, outward, retained). The cap comes after the filters."""
    seen = pair_statistics(scan(pairs, param, capped=False), param.fragments)
    intra = F.col("chr1") == F.col("chr2")
    too_long = F.coalesce(F.col("length") > max_frag, F.lit(False)) if max_frag is not None else F.lit(False)
    inward = intra & (F.col("orientation") == 1) & (F.col("insert") < min_inward) if min_inward is not None else F.lit(False)
    outward = intra & (F.col("orientation") == 2) & (F.col("insert") < min_outward) if min_outward is not None else F.lit(False)
    marked = seen.withColumn("too_long", too_long).withColumn("inward", inward).withColumn("outward", outward)
    passed = ~F.col("too_long") & ~F.col("inward") & ~F.col("outward")
    marked = marked.withColumn("passed", passed)
    cap = None if param.dnase else param.cap
    if cap:
        order = Window.partitionBy("lib", "anchor1_id", "anchor2_id", "passed").orderBy(*ORDER)
        marked = marked.withColumn("capped", F.col("passed") & (F.row_number().over(order) > cap))
    else:
        marked = marked.withColumn("capped", F.lit(False))
    totals = marked.agg(
        F.count_if(~F.col("capped")).alias("total"),
        F.count_if("too_long").alias("length"),
        F.count_if("inward").alias("inward"),
        F.count_if("outward").alias("outward"),
        F.count_if(F.col("passed") & ~F.col("capped")).alias("retained"),
    )
    return marked.filter(F.col("passed") & ~F.col("capped")).select(*pairs.columns), totals

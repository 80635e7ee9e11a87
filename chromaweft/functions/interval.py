"""Interval and small scalar expressions. Ranges are 1-based and closed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions per bucket of an interval join.
BUCKET = 1 << 16


def overlaps(s1: Column, e1: Column, s2: Column, e2: Column, kind: str = "any") -> Column:
    """any: share a base; within: the first lies in the second; start/end: touch there; equal."""
    return {
        "any": (s1 <= e2) & (e1 >= s2),
        "within": (s1 >= s2) & (e1 <= e2),
        "start": s1 == s2,
        "end": e1 == e2,
        "equal": (s1 == s2) & (e1 == e2),
    }[kind]


def interval_join(left: DataFrame, right: DataFrame, kind: str = "any", bucket: int = BUCKET, how: str = "inner") -> DataFrame:
    """Join l_* and r_* rows whose ranges overlap. left: l_chr, l_start, l_end, ...; right: r_chr, r_start, r_end, ...

    An equi-join on chromosome and bucket, which Spark can shuffle, broadcast or split; a pair that shares several
    buckets is taken in the first of them only.
    """
    lb = left.withColumn("__b", F.explode(F.sequence(F.floor(F.col("l_start") / bucket), F.floor(F.col("l_end") / bucket))))
    rb = right.withColumn("__rb", F.explode(F.sequence(F.floor(F.col("r_start") / bucket), F.floor(F.col("r_end") / bucket))))
    first = F.greatest(F.floor(F.col("l_start") / bucket), F.floor(F.col("r_start") / bucket))
    on = (F.col("l_chr") == F.col("r_chr")) & (F.col("__b") == F.col("__rb")) & (F.col("__b") == first)
    on = on & overlaps(F.col("l_start"), F.col("l_end"), F.col("r_start"), F.col("r_end"), kind)
    return lb.join(rb, on, how).drop("__b", "__rb")


def merge_ranges(ranges: DataFrame) -> DataFrame:
    """Disjoint chr, start, end; overlapping and abutting ranges become one."""
    order = Window.partitionBy("chr").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("start") <= F.col("__before") + 1, 0).otherwise(1)).over(order)
    marked = ranges.select("chr", "start", "end").withColumn("__before", before).withColumn("__island", island)
    return marked.groupBy("chr", "__island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("__island")


def reference_width(cigar: Column) -> Column:
    """Bases of the reference that a CIGAR string covers."""
    return F.aggregate(F.regexp_extract_all(cigar, F.lit(r"(\d+)[MDN=X]"), 1), F.lit(0), lambda a, x: a + x.cast("int"))


def clip_offset(cigar: Column, reverse: Column) -> Column:
    """Hard-clipped bases at the 5' side: of the first operation forward, of the last reverse."""
    clipped = F.when(reverse, F.regexp_extract(cigar, r"(\d+)H$", 1)).otherwise(F.regexp_extract(cigar, r"^(\d+)H", 1))
    # a cast of '' throws and catches, at some 30 microseconds a row
    return F.coalesce(F.when(cigar.contains("H"), F.nullif(clipped, F.lit("")).try_cast("int")), F.lit(0))


def five_prime(pos: Column, length: Column) -> Column:
    return F.when(length < 0, pos - length - 1).otherwise(pos)


def colour(strength: Column, rgb: tuple[int, int, int] = (0, 0, 0)) -> Column:
    """White to the colour, as #RRGGBB."""
    s = F.least(F.lit(1.0), F.greatest(F.lit(0.0), strength))
    return F.format_string("#%02X%02X%02X", *[F.round(F.lit(255) - F.lit(255 - c) * s).cast("int") for c in rgb])

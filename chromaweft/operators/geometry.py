"""What plots of interactions need: rectangles, turned squares and colours. Drawing is left to others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chromaweft.functions.interval import colour
from chromaweft.operators.counts import binned_pairs, extract_patch
from chromaweft.operators.filters import with_ends
from chromaweft.plans.param import Interactions, PairParam

Region = tuple[str, int, int]


def plaid(pairs: DataFrame, param: PairParam, first: Region, second: Region | None = None, width: int = 10000, rgb: tuple[int, int, int] = (0, 0, 0), max_count: float = 20, diagonal: bool = True) -> DataFrame:
    """x0, x1, y0, y1, count, colour: a rectangle per bin pair of two regions, mirrored within a chromosome."""
    second = second or first
    cells = extract_patch(pairs, param, first, second, width)
    _, regions = binned_pairs(pairs, param, width)
    r = regions.select("region_id", "start", "end", "chr")
    both = cells.join(r.toDF("a1", "s1", "e1", "c1"), "a1").join(r.toDF("a2", "s2", "e2", "c2"), "a2")
    shade = colour(F.least(F.lit(1.0), F.col("count") / max_count), rgb)
    as_is = both.select(F.when(F.col("flipped"), F.col("s2")).otherwise(F.col("s1")).alias("xs"), F.when(F.col("flipped"), F.col("e2")).otherwise(F.col("e1")).alias("xe"), F.when(F.col("flipped"), F.col("s1")).otherwise(F.col("s2")).alias("ys"), F.when(F.col("flipped"), F.col("e1")).otherwise(F.col("e2")).alias("ye"), "count", (F.col("a1") == F.col("a2")).alias("on"), (F.col("c1") == F.col("c2")).alias("same"))
    mirror = as_is.filter(F.col("same") & ~F.col("on")).select(F.col("ys").alias("xs"), F.col("ye").alias("xe"), F.col("xs").alias("ys"), F.col("xe").alias("ye"), "count", "on", "same")
    drawn = as_is.unionByName(mirror)
    drawn = drawn if diagonal else drawn.filter(~F.col("on"))
    inside = (F.col("xs") <= first[2]) & (F.col("xe") >= first[1]) & (F.col("ys") <= second[2]) & (F.col("ye") >= second[1])
    return drawn.filter(inside).select((F.col("xs") - 0.5).alias("x0"), (F.col("xe") + 0.5).alias("x1"), (F.col("ys") - 0.5).alias("y0"), (F.col("ye") + 0.5).alias("y1"), "count", shade.alias("colour"))


def _corners(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """A bin pair turned by 45 degrees: x the middle, y the distance."""
    def at(x: Column, y: Column) -> Column:
        return F.struct(((x + y) / 2).alias("x"), (x - y).cast("double").alias("y"))

    return F.array(at(s1 - 0.5, s2 - 0.5), at(s1 - 0.5, e2 + 0.5), at(e1 + 0.5, e2 + 0.5), at(e1 + 0.5, s2 - 0.5))


def turned(pairs: DataFrame, param: PairParam, region: Region, width: int = 10000, rgb: tuple[int, int, int] = (0, 0, 0), max_count: float = 20, max_height: float | None = None) -> DataFrame:
    """corners, count, colour of the bin pairs of one region, turned; corners below 0 belong under the axis."""
    cells = extract_patch(pairs, param, region, region, width)
    _, regions = binned_pairs(pairs, param, width)
    r = regions.select("region_id", "start", "end")
    both = cells.join(r.toDF("a1", "s1", "e1"), "a1").join(r.toDF("a2", "s2", "e2"), "a2")
    if max_height is not None:
        both = both.filter(F.col("s1") - F.col("e2") - 1 <= max_height)
    return both.select(_corners(F.col("s1"), F.col("e1"), F.col("s2"), F.col("e2")).alias("corners"), "count", colour(F.col("count") / max_count, rgb).alias("colour"))


def two_sided(fc: Column, limit: float, up: tuple[int, int, int] = (255, 0, 0), down: tuple[int, int, int] = (0, 0, 255)) -> Column:
    return F.when(fc >= 0, colour(fc / limit, up)).otherwise(colour(-fc / limit, down))


def differential_plaid(data: Interactions, fold_changes: DataFrame, first: Region, second: Region | None = None, limit: float | None = None) -> DataFrame:
    """Rectangles of interactions with a fold change (a1, a2, fc), coloured by sign and size; nothing beyond half a width and 100 bases."""
    second = second or first
    slack = (data.width or 0) / 2 + 100
    both = with_ends(data).join(fold_changes, ["a1", "a2"])
    limit = limit or both.agg(F.max(F.abs("fc"))).first()[0] or 1.0

    def near(i: int, region: Region) -> Column:
        return (F.col(f"chr{i}") == region[0]) & (F.col(f"start{i}") <= region[2] + slack) & (F.col(f"end{i}") >= region[1] - slack)

    def rows(i: int, j: int) -> DataFrame:
        return both.filter(near(i, first) & near(j, second)).select((F.col(f"start{i}") - 0.5).alias("x0"), (F.col(f"end{i}") + 0.5).alias("x1"), (F.col(f"start{j}") - 0.5).alias("y0"), (F.col(f"end{j}") + 0.5).alias("y1"), "fc")

    return rows(1, 2).union(rows(2, 1)).distinct().withColumn("colour", two_sided(F.col("fc"), limit))


def differential_turned(data: Interactions, fold_changes: DataFrame, region: Region, max_height: float, limit: float | None = None) -> DataFrame:
    both = with_ends(data).join(fold_changes, ["a1", "a2"])
    slack = 0.7 * max_height
    both = both.filter((F.col("chr1") == region[0]) & (F.col("chr2") == region[0]) & (F.col("start1") <= region[2] + slack) & (F.col("end2") >= region[1] - slack))
    limit = limit or both.agg(F.max(F.abs("fc"))).first()[0] or 1.0
    return both.select(_corners(F.col("start1"), F.col("end1"), F.col("start2"), F.col("end2")).alias("corners"), "fc", two_sided(F.col("fc"), limit).alias("colour"))

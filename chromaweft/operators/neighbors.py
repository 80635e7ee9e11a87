"""Counts in the neighbourhood of bin pairs, and the peaks that stand out of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chromaweft.functions.abundance import abundance
from chromaweft.operators.counts import square_counts
from chromaweft.plans.param import Interactions, PairParam

MODES = ("quadrant", "vertical", "horizontal", "surrounding")


def _place(data: Interactions) -> DataFrame:
    """pairs with chromosome indices, 0-based row and column within the chromosome pair, and the chromosomes' bin numbers."""
    r = data.regions.groupBy("chr_idx").agg(F.min("region_id").alias("first"), F.count(F.lit(1)).alias("size"))
    look = data.regions.select("region_id", "chr_idx").join(r, "chr_idx")
    one = look.toDF("c1", "a1", "first1", "size1")
    two = look.toDF("c2", "a2", "first2", "size2")
    out = data.pairs.join(one, "a1").join(two, "a2")
    return out.withColumn("row", F.col("a1") - F.col("first1")).withColumn("col", F.col("a2") - F.col("first2"))


def _span(low: Column, high: Column) -> Column:
    return F.greatest(F.lit(0), high - low + 1)


def _block(rows: tuple[Column, Column], cols: tuple[Column, Column]) -> Column:
    """Cells of a clipped block: rows in the chromosome; columns up to the diagonal within a chromosome, to the end else."""
    low_r, high_r = F.greatest(rows[0], F.lit(0)), F.least(rows[1], F.col("size1") - 1)
    low_c = F.greatest(cols[0], F.lit(0))
    whole = _span(low_r, high_r) * _span(low_c, F.least(cols[1], F.col("size2") - 1))

    def up_to(r: Column) -> Column:
        """Cells with column <= row over rows 0 .. r, for columns low_c .. cols[1]."""
        steps = F.greatest(F.lit(0), F.least(r, cols[1]) - low_c + 1)
        flat = F.greatest(F.lit(0), r - F.greatest(cols[1], low_c - 1))
        return steps * (steps + 1) / 2 + flat * _span(low_c, cols[1])

    below = F.when(high_r >= low_r, up_to(high_r) - up_to(low_r - 1)).otherwise(0.0)
    return F.when(F.col("c1") == F.col("c2"), below).otherwise(whole).cast("long")


def areas(flank: int, exclude: int) -> dict[str, Column]:
    r, c = F.col("row"), F.col("col")
    intra = F.col("c1") == F.col("c2")

    def ring(rows, cols, rows_x, cols_x):
        return _block(rows, cols) - _block(rows_x, cols_x)

    w, x = flank, exclude
    return {
        "quadrant": F.when(intra, ring((r - w, r), (c, c + w), (r - x, r), (c, c + x))).otherwise(F.lit(0).cast("long")),
        "vertical": ring((r - w, r + w), (c, c), (r - x, r + x), (c, c)),
        "horizontal": ring((r, r), (c - w, c + w), (r, r), (c - x, c + x)),
        "surrounding": ring((r - w, r + w), (c - w, c + w), (r - x, r + x), (c - x, c + x)),
    }


def enriched_pairs(data: Interactions, flank: int = 5, exclude: int = 0) -> Interactions:
    """Adds, per neighbourhood, the counts (n_<mode>, one slot per library) and the area (area_<mode>).

    Rows are spread over the rows they neighbour (2 * flank + 1 copies at most), then one range window over the
    columns sums each. Windows are keyed by chromosome pair and row, so no task holds a chromosome.
    """
    if not 0 <= exclude < flank:
        raise ValueError("exclude must be at least 0 and less than flank")
    w, x, n = flank, exclude, len(data.libraries)
    placed = _place(data)
    key = ["c1", "c2"]
    counts = [F.get("counts", F.lit(i)).alias(f"k{i}") for i in range(n)]
    cells = placed.select(*key, "row", "col", *counts)
    spread = cells.withColumn("dr", F.explode(F.sequence(F.lit(-w), F.lit(w)))).withColumn("at", F.col("row") + F.col("dr"))
    # the row itself asks; its neighbours within w rows answer
    spread = spread.select(*key, F.col("at").alias("row"), "col", F.col("dr").alias("dr"), *[f"k{i}" for i in range(n)])
    # a cell at row - dr contributes to row: dr > 0 means it lies below in row number
    inner = F.abs(F.col("dr")) <= x
    parts = {
        "up": (F.col("dr") >= 0) & (F.col("dr") <= w),  # rows row - w .. row
        "up_in": (F.col("dr") >= 0) & (F.col("dr") <= x),
        "all": F.lit(True),
        "all_in": inner,
        "own": F.col("dr") == 0,
    }
    sums = [F.sum(F.when(p, F.col(f"k{i}")).otherwise(0)).alias(f"{name}{i}") for name, p in parts.items() for i in range(n)]
    columns = spread.groupBy(*key, "row", "col").agg(F.max(F.when(F.col("dr") == 0, 1).otherwise(0)).alias("real"), *sums)
    frame = Window.partitionBy(*key, "row").orderBy("col")

    def over(name: str, i: int, low: int, high: int) -> Column:
        return F.coalesce(F.sum(f"{name}{i}").over(frame.rangeBetween(low, high)), F.lit(0))

    intra = F.col("c1") == F.col("c2")
    made = {}
    for i in range(n):
        made[f"quadrant{i}"] = F.when(intra, over("up", i, 0, w) - over("up_in", i, 0, x)).otherwise(0)
        made[f"vertical{i}"] = F.col(f"all{i}") - F.col(f"all_in{i}")
        made[f"horizontal{i}"] = over("own", i, -w, w) - over("own", i, -x, x)
        made[f"surrounding{i}"] = over("all", i, -w, w) - over("all_in", i, -x, x)
    summed = columns.select(*key, "row", "col", "real", *[v.alias(k) for k, v in made.items()]).filter("real = 1").drop("real")
    summed = summed.select(*key, "row", "col", *[F.array(*[F.col(f"{m}{i}") for i in range(n)]).alias(f"n_{m}") for m in MODES])
    out = placed.join(summed, [*key, "row", "col"])
    for mode, area in areas(w, x).items():
        out = out.withColumn(f"area_{mode}", area)
    return data.with_pairs(out.select(*data.pairs.columns, *[f"n_{m}" for m in MODES], *[f"area_{m}" for m in MODES]))


def neighbor_counts(pairs: DataFrame, param: PairParam, libraries: tuple[str, ...], width: int = 50000, least: int = 1, flank: int = 5, exclude: int = 0) -> Interactions:
    """square_counts without filter, then neighbourhoods, then the filter."""
    data = enriched_pairs(square_counts(pairs, param, libraries, width, least=1), flank, exclude)
    total = F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, v: a + v)
    return data.with_pairs(data.pairs.filter(total >= least))


def filter_peaks(data: Interactions, totals: list[int], min_enrich: float = 0.5849625007211562, min_count: float = 5, min_diag: int = 2, prior: float = 2.0) -> DataFrame:
    """pairs with enrichment (log2 over the highest background) and keep.

    A background is the neighbourhood's abundance for its area; one of area 0 is never the highest.
    """
    own = abundance(F.col("counts"), totals, prior)
    backgrounds = [F.when(F.col(f"area_{m}") > 0, abundance(F.col(f"n_{m}"), totals, prior, F.col(f"area_{m}"))).otherwise(F.lit(float("-inf"))) for m in MODES]
    look = data.regions.select("region_id", "chr_idx")
    out = data.pairs.join(look.toDF("a1", "__c1"), "a1").join(look.toDF("a2", "__c2"), "a2")
    mean = sum(totals) / len(totals)
    least = abundance(F.array(F.lit(float(min_count))), [mean], prior)
    far = (F.col("__c1") != F.col("__c2")) | (F.col("a1") - F.col("a2") >= min_diag)
    out = out.withColumn("abundance", own).withColumn("enrichment", own - F.greatest(*backgrounds))
    return out.withColumn("keep", (F.col("enrichment") > min_enrich) & (F.col("abundance") > least) & far).drop("__c1", "__c2")

"""Distances, areas and the abundance and distance filters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chromaweft.functions.abundance import abundance
from chromaweft.plans.param import Interactions


def with_ends(data: Interactions) -> DataFrame:
    """pairs with chr1, start1, end1, nf1 and the same for the second end."""
    r = data.regions.select("region_id", "chr", "start", "end", "nfrags")
    return data.pairs.join(r.toDF("a1", "chr1", "start1", "end1", "nf1"), "a1").join(r.toDF("a2", "chr2", "start2", "end2", "nf2"), "a2")


def same_chromosome() -> Column:
    return F.col("chr1") == F.col("chr2")


def distance(kind: str = "mid") -> Column:
    """mid: between middles, halves kept; diag: of bin numbers; gap: bases between; null across chromosomes."""
    value = {
        "mid": F.abs((F.col("start1") + F.col("end1")) / 2 - (F.col("start2") + F.col("end2")) / 2),
        "diag": (F.col("a1") - F.col("a2")).cast("double"),
        "gap": (F.greatest("start1", "start2") - F.least("end1", "end2") - 1).cast("double"),
    }[kind]
    return F.when(same_chromosome(), value)


def area(bp: bool = True) -> Column:
    """Base pairs or fragments squared; overlapping ends count their shared square's half once."""
    if bp:
        whole = (F.col("end1") - F.col("start1") + 1).cast("double") * (F.col("end2") - F.col("start2") + 1)
        shared = F.least("end1", "end2") - F.greatest("start1", "start2") + 1
    else:
        whole = F.col("nf1").cast("double") * F.col("nf2")
        shared = F.when(F.col("a1") == F.col("a2"), F.col("nf1")).otherwise(0)
    overlap = F.when(same_chromosome() & (shared > 0), shared).otherwise(0).cast("double")
    return whole - overlap * (overlap - 1) / 2


def filter_diagonal(by_dist: float = 0, by_diag: int = 0, kind: str = "mid") -> Column:
    """Keep mask; pairs across chromosomes are kept always, and by_diag 0 does not ask for the diagonal."""
    keep = distance(kind) > by_dist
    if by_diag:
        keep = keep & (distance("diag") > by_diag)
    return F.coalesce(keep, F.lit(False)) | distance(kind).isNull()


def _possible(regions: DataFrame) -> tuple[int, int]:
    """Possible pairs within and across chromosomes."""
    sizes = [r["n"] for r in regions.groupBy("chr").agg(F.count(F.lit(1)).alias("n")).collect()]
    total, intra = sum(sizes) * (sum(sizes) + 1) // 2, sum(n * (n + 1) // 2 for n in sizes)
    return intra, total - intra


def direct_threshold(data: Interactions, totals: list[int], prior: float = 2.0, scale: float = 1.0) -> float | None:
    """Median abundance of all possible pairs across chromosomes, unseen ones counted as empty."""
    scored = with_ends(data).filter(~same_chromosome()).select(abundance(F.col("counts"), totals, prior, scale).alias("ab"))
    n = scored.count()
    possible = max(1, _possible(data.regions)[1])
    share = n / possible
    if share >= 1:
        return scored.agg(F.percentile("ab", 0.5)).first()[0]
    if share < 0.5:
        empty = data.pairs.sparkSession.range(1).select(abundance(F.array(*[F.lit(0)] * len(totals)), totals, prior, scale).alias("ab"))
        return empty.first()[0]
    return scored.agg(F.percentile("ab", 1 - 0.5 / share)).first()[0]


def filter_direct(data: Interactions, totals: list[int], prior: float = 2.0, reference: Interactions | None = None) -> tuple[DataFrame, float]:
    """(a1, a2, abundance), threshold. With a reference of wider bins, both are put on its scale by area."""
    if reference is None:
        return data.pairs.select("a1", "a2", abundance(F.col("counts"), totals, prior).alias("abundance")), direct_threshold(data, totals, prior)
    scale = (reference.width / data.width) ** 2
    return data.pairs.select("a1", "a2", abundance(F.col("counts"), totals, prior).alias("abundance")), direct_threshold(reference, totals, prior, scale)


def _weighted_median(x: np.ndarray, n: np.ndarray) -> float:
    """The median of each x repeated n times."""
    order = np.argsort(x, kind="stable")
    x, total = x[order], np.cumsum(n[order])
    low, high = np.searchsorted(total, [total[-1] / 2, total[-1] / 2 + 1e-9 * total[-1]])
    return (x[min(low, len(x) - 1)] + x[min(high, len(x) - 1)]) / 2


def lowess(x: np.ndarray, y: np.ndarray, span: float, at: np.ndarray | None = None, robust: int = 3, n: np.ndarray | None = None) -> np.ndarray:
    """Cleveland's local linear fit with tricube weights and bisquare re-weighting, on sorted distinct knots joined by lines.

    n: how many points stand behind each; span, fit and median are then over those.
    """
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    n = np.ones(len(x)) if n is None else np.asarray(n, float)[order]
    k = max(2, int(span * n.sum() + 0.5))
    knots = np.unique(x)
    if len(knots) > 400:
        knots = np.unique(np.quantile(x, np.linspace(0, 1, 400)))
    near = []
    for p in knots:
        d = np.abs(x - p)
        by = np.argsort(d, kind="stable")
        h = max(d[by[min(np.searchsorted(np.cumsum(n[by]), k), len(x) - 1)]], 1e-12)
        if (d < h).sum() < 2 and len(x) > 1:  # one heavy mean fills the span; a line needs its neighbours
            h = max(h, d[by[min(2, len(x) - 1)]])
        w = np.clip(1 - (d / h) ** 3, 0, None) ** 3 * n
        inside = np.flatnonzero(w)
        near.append((inside, w[inside]))
    weight = np.ones(len(x))
    fit = np.zeros(len(knots))
    for _ in range(robust + 1):
        for i, (p, (inside, tricube)) in enumerate(zip(knots, near)):
            w = tricube * weight[inside]
            s = w.sum()
            if s <= 0:
                fit[i] = np.average(y[inside], weights=tricube) if len(inside) else np.interp(p, x, y)
                continue
            mx, my = (w * x[inside]).sum() / s, (w * y[inside]).sum() / s
            v = (w * (x[inside] - mx) ** 2).sum()
            slope = (w * (x[inside] - mx) * (y[inside] - my)).sum() / v if v > 1e-10 * s else 0.0
            fit[i] = my + slope * (p - mx)
        r = np.abs(y - np.interp(x, knots, fit))
        m = 6 * _weighted_median(r, n)
        if m <= 0:
            break
        weight = np.clip(1 - (r / m) ** 2, 0, None) ** 2
    return np.interp(x if at is None else at, knots, fit)


def trended(data: Interactions, totals: list[int], span: float = 0.25, prior: float = 2.0, steps: int = 512, reference: Interactions | None = None) -> DataFrame:
    """pairs with abundance, log_distance and trend: the distance trend within chromosomes, the direct threshold across.

    Unseen pairs within a chromosome enter as empty ones (not without a prior, where they have no abundance). What is fitted are means
    over `steps` bins of distance weighted by their pairs, so the fit's size does not grow with the pairs. With a reference of wider bins, the trend and
    the threshold are those of the reference, its counts scaled by the bins' areas.
    """
    ends = _with_abundance(data, totals, prior, 1.0)
    if reference is None:
        x, y, threshold = _trend(data, ends, totals, span, prior, steps, 1.0)
    else:
        scale = (reference.width / data.width) ** 2
        x, y, threshold = _trend(reference, _with_abundance(reference, totals, prior, scale), totals, span, prior, steps, scale)
    if not len(x):
        return ends.withColumn("trend", F.lit(threshold))
    knots = F.array(*[F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y")) for a, b in zip(x, y)])
    return ends.withColumn("trend", F.when(same_chromosome(), interpolate(F.col("log_distance"), knots, len(x))).otherwise(F.lit(threshold)))


def _with_abundance(data: Interactions, totals: list[int], prior: float, scale: float) -> DataFrame:
    return with_ends(data).withColumn("abundance", abundance(F.col("counts"), totals, prior, scale)).withColumn("log_distance", F.log10(distance() + (data.width or 1)))


def _trend(data: Interactions, ends: DataFrame, totals: list[int], span: float, prior: float, steps: int, scale: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Log distances and the trend there, and the threshold across chromosomes."""
    width = data.width or 1
    seen = ends.filter(same_chromosome() & F.col("abundance").isNotNull())
    intra, _ = _possible(data.regions)
    n_seen = seen.count()
    points = seen.select("log_distance", "abundance")
    if n_seen * 2 >= intra and prior > 0:
        r = data.regions.select("region_id", "chr", "start", "end")
        one, two = r.toDF("a1", "chr1", "start1", "end1"), r.toDF("a2", "chr2", "start2", "end2")
        empty = abundance(F.array(*[F.lit(0)] * len(totals)), totals, prior, scale)
        unseen = one.join(two, (F.col("chr1") == F.col("chr2")) & (F.col("a1") >= F.col("a2"))).join(seen.select("a1", "a2"), ["a1", "a2"], "left_anti")
        points = points.union(unseen.select(F.log10(distance() + width), empty))
    span_of = points.agg(F.min("log_distance").alias("a"), F.max("log_distance").alias("b")).first()
    threshold = direct_threshold(data, totals, prior, scale)
    if span_of["a"] is None:
        return np.zeros(0), np.zeros(0), threshold
    step = max((span_of["b"] - span_of["a"]) / steps, 1e-9)
    binned = points.groupBy(F.floor((F.col("log_distance") - span_of["a"]) / step).alias("g")).agg(F.avg("log_distance").alias("x"), F.avg("abundance").alias("y"), F.count(F.lit(1)).alias("n")).orderBy("g").collect()
    x, y, n = (np.array([b[c] for b in binned], float) for c in "xyn")
    return x, lowess(x, y, span, n=n), threshold


def interpolate(x: Column, knots: Column, n: int) -> Column:
    """Linear between sorted knots, constant beyond."""
    below = F.greatest(F.lit(0), F.least(F.lit(max(n - 2, 0)), F.size(F.filter(knots, lambda k: k["x"] <= x)) - 1))
    a, b = F.get(knots, below), F.get(knots, F.least(below + 1, F.lit(n - 1)))
    share = F.when(b["x"] > a["x"], F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - a["x"]) / (b["x"] - a["x"])))).otherwise(0.0)
    return a["y"] + share * (b["y"] - a["y"])

"""Trends over many cells against fits of every point."""

import numpy as np

from chromaweft.operators.filters import lowess
from chromaweft.operators.normalize import copy_number_offsets
from chromaweft.plans.param import Interactions


def _direct(x, y, span, at):
    """One local linear fit of all points, without bins."""
    k = int(span * len(x) + 0.5)
    out = []
    for p in at:
        d = np.abs(x - p)
        w = np.clip(1 - (d / np.partition(d, k - 1)[k - 1]) ** 3, 0, None) ** 3
        a = np.column_stack([np.ones(len(x)), x - p])
        out.append(np.linalg.solve((a * w[:, None]).T @ a, (a * w[:, None]).T @ y)[0])
    return np.array(out)


def test_binned_trend_counts_points_not_bins():
    rng = np.random.default_rng(1)
    x = 4 + 3 * rng.random(20000) ** 4  # most near the diagonal
    y = np.sin(3 * x) + 0.1 * rng.standard_normal(len(x))
    g = np.floor((x - x.min()) / (np.ptp(x) / 512))
    g = np.unique(g, return_inverse=True)[1]
    n = np.bincount(g)
    bx, by = np.bincount(g, x) / n, np.bincount(g, y) / n
    at = np.linspace(4.05, 6.5, 20)
    want = _direct(x, y, 0.25, at)
    got = lowess(bx, by, 0.25, at, robust=0, n=n)
    assert np.abs(got - want).max() < 0.05
    assert np.abs(lowess(bx, by, 0.25, at, robust=0) - want).max() > 0.2  # each bin counted once


def test_repeated_points_are_case_weights():
    rng = np.random.default_rng(2)
    x, n = np.sort(rng.random(60)), rng.integers(1, 9, 60)
    y = x**2 + 0.05 * rng.standard_normal(60)
    assert np.allclose(lowess(x, y, 0.3, n=n), lowess(np.repeat(x, n), np.repeat(y, n), 0.3, at=x), atol=1e-6)


def test_offsets_follow_a_few_amplified_bins_among_many_pairs(spark):
    """45,150 pairs; one bin in 300 is amplified eight times in the first library."""
    rng, bins = np.random.default_rng(3), 300
    gain = np.ones(bins)
    gain[7] = 8
    a1, a2 = np.tril_indices(bins)
    base = 40 * np.exp(0.3 * rng.standard_normal(len(a1)))
    counts = np.column_stack([rng.poisson(base * gain[a1] * gain[a2]), rng.poisson(base)])
    pairs = spark.createDataFrame([(int(a), int(b), [int(x) for x in c]) for a, b, c in zip(a1, a2, counts)], "a1 long, a2 long, counts array<long>")
    depth = [[int(12000 * g), 12000] for g in gain]
    margins = spark.createDataFrame([(i, c) for i, c in enumerate(depth)], "region_id long, counts array<long>")
    data = Interactions.__new__(Interactions)
    object.__setattr__(data, "pairs", pairs)
    object.__setattr__(data, "libraries", ("u", "v"))
    totals = [int(x) for x in counts.sum(axis=0)]
    got = copy_number_offsets(data, margins, totals).toPandas()
    assert len(got) == len(a1)
    diff = got["offsets"].map(lambda o: o[0] - o[1])
    hit = (got["a1"] == 7) ^ (got["a2"] == 7)
    assert abs((diff[hit].median() - diff[~hit].median()) - np.log(8)) < 0.3

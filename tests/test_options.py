"""Options and forms of operators that the registered queries do not reach, against plain code."""

import gzip
import math
import struct
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from chromaweft.functions.abundance import abundance
from chromaweft.operators import components, counts, filters, normalize, ordered, results
from chromaweft.plans import demo
from chromaweft.plans.param import Interactions, PairParam
from chromaweft.sources import alignments, matrices, store
from tests.test_pairing import ALIGNMENTS, FRAGMENTS

REGIONS = "region_id long, chr string, chr_idx int, start int, end int, nfrags long"


def _bins(spark, sizes, width=10):
    rows, k = [], 0
    for c, n in enumerate(sizes):
        for i in range(n):
            k += 1
            rows.append((k, f"c{c}", c, i * width + 1, (i + 1) * width, 1))
    return spark.createDataFrame(rows, REGIONS)


def _set(spark, cells, sizes, width=10, libraries=("x",)):
    pairs = spark.createDataFrame([(a, b, list(c)) for a, b, *c in cells], "a1 long, a2 long, counts array<long>")
    totals = spark.createDataFrame([(x, 1000) for x in libraries], "lib string, total long")
    return Interactions(pairs, _bins(spark, sizes, width), libraries, totals, width)


# ---- order


def test_numbers_and_running_values(spark):
    rng = np.random.default_rng(1)
    x = rng.permutation(1000).tolist()
    df = spark.createDataFrame([(v, float(v % 7 + 1)) for v in x], "v long, w double").repartition(5)
    assert {r["v"]: r["n"] for r in ordered.numbered(df, "v", out="n").collect()} == {v: v + 1 for v in range(1000)}
    ranged = ordered.in_ranges(df, "v")
    up = np.cumsum([v % 7 + 1 for v in range(1000)])
    assert {r["v"]: r["s"] for r in ordered.running_sum(ranged, "w", "v", out="s").collect()} == {v: float(s) for v, s in enumerate(up)}
    least = np.minimum.accumulate(np.array([v % 7 + 1.0 for v in range(1000)])[::-1])[::-1]
    assert {r["v"]: r["m"] for r in ordered.least_behind(ranged, "w", "v", out="m").collect()} == dict(enumerate(least.tolist()))
    none = df.filter("false")
    assert ordered.numbered(none, "v", out="n").count() == 0 and ordered.running_sum(ordered.in_ranges(none, "v"), "w", "v", out="s").count() == 0


def test_components_of_a_path_and_too_few_rounds(spark):
    name = np.random.default_rng(2).permutation(201).tolist()
    path = spark.createDataFrame(list(zip(name, name[1:])), "a long, b long")
    assert {r["component"] for r in components.connected_components(path).collect()} == {0}
    with pytest.raises(RuntimeError, match="2 rounds"):
        components.connected_components(path, max_rounds=2)


def test_weighted_fdr_with_ties(spark):
    rng = np.random.default_rng(3)
    p, w = np.round(rng.random(300), 2) + 1e-3, rng.random(300)
    order = np.argsort(p, kind="stable")
    raw = w.sum() * p[order] / np.cumsum(w[order])
    for i in range(298, -1, -1):
        raw[i] = min(raw[i], raw[i + 1])
    want = {}
    for i, v in zip(order, raw):  # of equal p-values the largest cumulative weight counts
        want[p[i]] = min(1.0, v) if p[i] not in want else min(want[p[i]], min(1.0, v))
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(p, w)], "p_value double, weight double")
    for r in results.weighted_fdr(df).collect():
        assert r["adjusted"] == pytest.approx(want[r["p_value"]])


# ---- alignments and stores


def _bam(path, names, rows, members=3):
    body = b"BAM\1" + struct.pack("<i", 4) + b"@HD\t"
    body += struct.pack("<i", len(names)) + b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", 1000) for n in names)
    for name, flag, chrom, pos, mapq, cigar in rows:
        ops = [int(n) << 4 | "MIDNSHP=X".index(o) for n, o in alignments_ops(cigar)]
        raw = name.encode() + b"\0"
        fixed = struct.pack("<iiBBHHHiiii", names.index(chrom) if chrom != "*" else -1, pos - 1, len(raw), mapq, 0, len(ops), flag, 3, -1, -1, 0)
        record = fixed + raw + struct.pack(f"<{len(ops)}I", *ops) + b"\x12\x30" + b"\xff" * 3
        body += struct.pack("<i", len(record)) + record
    cuts = [len(body) * i // members for i in range(members + 1)]
    path.write_bytes(b"".join(gzip.compress(body[a:b]) for a, b in zip(cuts, cuts[1:])) + gzip.compress(b""))


def alignments_ops(cigar):
    import re

    return re.findall(r"(\d+)([MIDNSHP=X])", cigar)


def test_bam(spark, tmp_path):
    _bam(tmp_path / "x.bam", ["chrA", "chrB"], [*ALIGNMENTS, ("lost", 77, "*", 0, 0, "*")])
    got = [tuple(r) for r in alignments.read_bam(spark, str(tmp_path / "x.bam")).collect()]
    assert got == [*ALIGNMENTS, ("lost", 77, "*", 0, 0, "*")]
    fragments = spark.createDataFrame(FRAGMENTS, "frag_id int, chr string, chr_idx int, start int, end int")
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        totals = alignments.prep_pseudo_pairs(alignments.read_bam(spark, str(tmp_path / "x.bam")).filter("chr <> '*'"), fragments, chim_span=20, ichim=False)[1].first()
    assert any(w.category is DeprecationWarning for w in seen)
    assert tuple(totals) == (32, 7, 3, 22, 4, 1, 2, 12, 8, 7, 6)
    whole = (tmp_path / "x.bam").read_bytes()
    for name, data in (("cut.bam", whole[: len(whole) // 2]), ("other.bam", gzip.compress(b"SAM\1" + b"\0" * 20))):
        (tmp_path / name).write_bytes(data)
        with pytest.raises(Exception, match="ends within|not a BAM"):
            alignments.read_bam(spark, str(tmp_path / name)).collect()


def test_pruning_a_store_without_fragments(spark, tmp_path):
    rows = [("l", "a", "a", 0, 0, 100, 50, 10, -10), ("l", "a", "a", 0, 0, 500, 60, 10, -10), ("l", "b", "a", 0, 0, 7, 80, 10, 10)]
    df = spark.createDataFrame(rows, "lib string, chr1 string, chr2 string, anchor1_id int, anchor2_id int, anchor1_pos int, anchor2_pos int, anchor1_len int, anchor2_len int")
    chromosomes = spark.createDataFrame([("a", 0, 1000), ("b", 1, 1000)], "chr string, chr_idx int, length int")
    path = str(tmp_path / "store")
    store.save_pairs(df, path, chromosomes)
    param = PairParam(chromosomes=chromosomes)
    totals = store.prune_store(spark, path, param, str(tmp_path / "out"), min_outward=100)
    assert totals.first()["retained"] == 2 and store.load_store(spark, str(tmp_path / "out")).count() == 2
    assert store.load_store(spark, path).count() == 3
    store.prune_store(spark, path, param, min_outward=100)
    assert store.load_store(spark, path).count() == 2 and sorted(p.name for p in tmp_path.iterdir()) == ["out", "store"]


def test_matrices_keep_fractions(spark):
    regions = _bins(spark, [3])
    one = spark.createDataFrame([(2, 1, 0.5), (3, 1, 0.2), (3, 3, None)], "row long, col long, value double")
    two = spark.createDataFrame([(1, 2, 0.6), (1, 3, 0.3)], "row long, col long, value double")
    data = matrices.merge_matrices([one, two], regions)
    assert {(r["a1"], r["a2"]): r["counts"] for r in data.pairs.collect()} == {(2, 1): [0.5, 0.6]}
    whole = matrices.merge_matrices([one, two], regions, as_integer=True)
    assert {(r["a1"], r["a2"]): r["counts"] for r in whole.pairs.collect()} == {(2, 1): [0, 0]}


# ---- sets of several sizes


def _fragment_sets(spark, sf="/root/testdata/sf0.001"):
    p, param = demo.pairs(spark, sf, near=True).withColumn("lib", F.lit("x")), demo.param(spark, sf)
    small, large = (counts.square_counts(p, param, ("x",), w, least=1) for w in (5000, 10000))
    return small, large, param


def test_boxes_of_several_sizes(spark):
    small, large, param = _fragment_sets(spark)
    indices, boxes = results.box_pairs([small, large], param, reference=20000)
    parents = {r["region_id"]: r for r in counts.bin_regions(counts.fragment_bins(param.fragments, 20000)).collect()}
    number = {}
    want = []
    for data in (small, large):
        r = {x["region_id"]: x for x in data.regions.collect()}
        first = {i: min(k for k, p in parents.items() if p["chr"] == x["chr"] and p["start"] <= x["start"] and x["end"] <= p["end"]) for i, x in r.items()}
        want.append({(x["a1"], x["a2"]): (first[x["a1"]], first[x["a2"]]) for x in data.pairs.collect()})
    for k, p in enumerate(sorted(set(want[0].values()) | set(want[1].values())), 1):
        number[p] = k
    for got, expected in zip(indices, want):
        assert {(r["a1"], r["a2"]): r["box_index"] for r in got.collect()} == {k: number[p] for k, p in expected.items()}
    for r in boxes.collect():
        a, b = next(p for p, k in number.items() if k == r["box_index"])
        assert (r["start1"], r["end2"]) == (parents[a]["start"], parents[b]["end"])
    assert results.box_pairs([small, large], param, reference=20000, index_only=True)[1] is None
    least = {r["box_index"]: r for r in results.box_pairs([small, large], param, reference=20000, minbox=True)[1].collect()}
    regions = {r["region_id"]: r for r in small.regions.collect()}
    one = next(iter(want[0].items()))
    assert least[number[one[1]]]["min_start1"] <= regions[one[0][0]]["start"] and len(least) == len(number)
    with pytest.raises(Exception, match="no larger one"):
        results.box_pairs([small, large], param, reference=7000)


def test_box_with_one_end_in_a_parent(spark):
    rows = [(1, "c", 1, 10, "c", 11, 20), (2, "c", 5, 15, "c", 1, 10), (3, "c", 1, 10, "d", 1, 10), (4, "d", 1, 10, "d", 1, 10), (5, "c", 11, 20, "c", 1, 5)]
    boxes = spark.createDataFrame(rows, "box_id long, chr1 string, start1 int, end1 int, chr2 string, start2 int, end2 int")
    parents = spark.createDataFrame([(1, "c", 1, 10), (2, "c", 11, 20)], "region_id long, chr string, start int, end int")
    got = {r["box_id"]: (r["p1"], r["p2"], r["box_index"], r["min_start2"]) for r in results.nest_boxes(boxes, parents, smallest=True).collect()}
    none = (None, None, None, None)
    assert got == {1: (2, 1, 1, 1), 2: none, 3: none, 4: none, 5: (2, 1, 1, 1)}


def _clusters(boxes, tol):
    """Smallest box of each connected one."""
    root = {b[0]: b[0] for b in boxes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(boxes):
        for b in boxes[i + 1 :]:
            if a[1] == b[1] and a[4] == b[4] and all(max(a[k], b[k]) - min(a[k + 1], b[k + 1]) - 1 < tol for k in (2, 5)):
                x, y = sorted((find(a[0]), find(b[0])))
                root[y] = x
    return {b[0]: find(b[0]) for b in boxes}


def test_clusters_over_several_sets(spark):
    rng = np.random.default_rng(4)
    sets, boxes = [], []
    for k, width in enumerate((10, 30)):
        sizes = [60 // (1 + 2 * k), 30 // (1 + 2 * k)]
        cells = sorted({tuple(sorted(rng.integers(1, sum(sizes) + 1, 2).tolist(), reverse=True)) for _ in range(60)})
        sets.append(_set(spark, [(a, b, 1) for a, b in cells], sizes, width))
        r = {x["region_id"]: x for x in sets[-1].regions.collect()}
        boxes += [((k, a, b), r[a]["chr"], r[a]["start"], r[a]["end"], r[b]["chr"], r[b]["start"], r[b]["end"]) for a, b in cells]
    want = _clusters(sorted(boxes), 15)
    order = {root: i for i, root in enumerate(sorted(set(want.values())), 1)}
    indices, bounds = results.cluster_pairs(sets, 15, upper=None)
    got = {(k, r["a1"], r["a2"]): r["cluster_id"] for k, part in enumerate(indices) for r in part.collect()}
    assert got == {b: order[root] for b, root in want.items()} and bounds.count() == len(order)
    # combined p-values of the two sets
    tables = [spark.createDataFrame([(a, b, (7 * a + 3 * b) % 50 / 50 + 0.01) for (j, a, b), *_ in boxes if j == k], "a1 long, a2 long, p_value double") for k in (0, 1)]
    tests = {}
    for (k, a, b), c in got.items():
        tests.setdefault(c, []).append(((7 * a + 3 * b) % 50 / 50 + 0.01, k))
    for r in results.consolidate_sets(indices, tables).collect():
        mine = sorted(tests[r["cluster_id"]])
        n = [sum(j == k for _, j in mine) for k in (0, 1)]
        w = [1 / n[j] for _, j in mine]
        simes = min(p * sum(w) / sum(w[: max(i for i, (q, _) in enumerate(mine) if q == p) + 1]) for p, _ in mine)
        assert (r["n"], r["p_value"]) == (len(mine), pytest.approx(min(1.0, simes)))
    assert results.consolidate_sets(indices, tables, combine=lambda t: t.groupBy("cluster_id").agg(F.min("p_value").alias("p"))).count() == len(order)
    with pytest.raises(Exception, match="differ"):
        results.consolidate_sets(indices, [tables[0].filter("p_value < 0.5"), tables[1]]).collect()
    with pytest.raises(ValueError):
        results.consolidate_sets(indices, tables[:1])


def _plain_search(boxes, p, sets, up, target, tol, grid, rounds):
    n = {s: sum(x == s for x in sets.values()) for s in set(sets.values())}
    w = {b: 1 / n[sets[b]] for b in p}
    order = sorted(p, key=p.get)
    adjusted, total, at = {}, sum(w.values()), 0.0
    for v in sorted(set(p.values())):
        at += sum(w[b] for b in order if p[b] == v)
        for b in order:
            if p[b] == v:
                adjusted[b] = total * v / at
    low = 1.0
    for b in reversed(order):
        low = min(low, adjusted[b])
        adjusted[b] = min(low, min(adjusted[c] for c in order if p[c] == p[b]))

    def clusters(limit):
        out = {}
        for sign in (False, True):
            out.update({b: (sign, c) for b, c in _clusters([x for x in boxes if adjusted[x[0]] <= limit and up[x[0]] == sign], tol).items()})
        return out

    def fdr(limit):
        found = clusters(limit)
        size = {}
        for b, c in found.items():
            size[c] = size.get(c, 0) + w[b]
        false, left = 0, limit * sum(size.values()) * (1 + 1e-9)
        for s in sorted(size.values()):
            left -= s
            false += left >= -1e-12
            if left < -1e-12:
                break
        return false / len(size) if size else 0.0

    a, b, best = 0.0, target, (0.0, 0.0)
    for _ in range(rounds):
        points = [a + (b - a) * k / (grid - 1) for k in range(grid)]
        found = [fdr(x) for x in points]
        k = max(k for k in range(grid) if k == 0 or found[k] <= target)
        best = (points[k], found[k]) if k else best
        if k == grid - 1:
            break
        a, b = points[k], points[k + 1]
    return clusters(best[0]), best


def test_significant_clusters_against_a_plain_search(spark):
    rng = np.random.default_rng(6)
    rows, boxes, p, sets, up = [], [], {}, {}, {}
    for i in range(260):
        s, (x, y) = i % 2, (rng.integers(0, 14, 2) * 10).tolist()
        sets[i], up[i] = s, bool(rng.random() < 0.5)
        p[i] = float(rng.random() if x > 60 else rng.random() * 0.004)
        boxes.append((i, "a", x + 1, x + 10, "a", y + 1, y + 10))
        rows.append((i, s, *boxes[-1][1:], p[i], 1.0 if up[i] else -1.0))
    df = spark.createDataFrame(rows, "box_id long, set_id int, chr1 string, start1 int, end1 int, chr2 string, start2 int, end2 int, p_value double, fc double")
    want, best = _plain_search(boxes, p, sets, up, 0.1, 1, 11, 3)
    found, threshold, fdr = results.significant_clusters(df, 0.1, 1, None, "fc", grid=11, rounds=3)
    got = {r["box_id"]: r["cluster_id"] for r in found.collect()}
    assert (threshold, fdr) == (pytest.approx(best[0]), pytest.approx(best[1])) and 0 < len(got) < len(rows)
    assert set(got) == set(want)
    assert len({(got[b], want[b]) for b in got}) == len(set(got.values())) == len(set(want.values()))


def test_significant_pairs_of_sets(spark):
    one = _set(spark, [(a, b, 1) for a in range(1, 13) for b in range(1, a + 1)], [12])
    table = one.pairs.select("a1", "a2", F.when((F.col("a1") < 4), 1e-8).otherwise(0.9).alias("p_value"))
    indices, bounds, fdr = results.significant_pairs([one], [table], rounds=2)
    got = {(r["a1"], r["a2"]): r["cluster_id"] for r in indices[0].collect()}
    assert len(got) == 78 and {k for k, v in got.items() if v is not None} == {(a, b) for a in range(1, 4) for b in range(1, a + 1)}
    assert bounds.count() == 1 and fdr <= 0.05


# ---- filters and normalisation


def _grid(spark, width, bins, libraries=("x",), seed=0):
    rng = np.random.default_rng(seed)
    cells = []
    for a in range(1, 2 * bins + 1):
        for b in range(1, a + 1):
            same = (a <= bins) == (b <= bins)
            mean = 400 / (1 + a - b) * (width / 10) ** 2 / 4 if same else 2.0
            cells.append((a, b, *(int(rng.poisson(mean)) for _ in libraries)))
    return _set(spark, [c for c in cells if sum(c[2:])], [bins, bins], width, libraries)


def test_trend_by_a_reference(spark):
    data, wide = _grid(spark, 10, 24), _grid(spark, 40, 6, seed=1)
    total = [100_000]
    got = filters.trended(data, total, reference=wide).collect()
    ref = filters.with_ends(wide).withColumn("ab", abundance(F.col("counts"), total, 2.0, 16.0)).withColumn("d", F.log10(filters.distance() + 40)).collect()
    assert [r["abundance"] for r in got] == pytest.approx([math.log2((r["counts"][0] + 2) / (total[0] + 4) * 1e6) for r in got])
    inter = np.array([math.log2((r["counts"][0] + 32) / (total[0] + 4) * 1e6 / 16) for r in ref if r["chr1"] != r["chr2"]])
    empty, possible = math.log2(2 / (total[0] + 4) * 1e6), 36
    share = len(inter) / possible
    want = np.median(inter) if share >= 1 else empty if share < 0.5 else np.quantile(inter, 1 - 0.5 / share)
    assert {round(r["trend"], 6) for r in got if r["chr1"] != r["chr2"]} == {round(float(want), 6)}
    points = [(r["d"], r["ab"]) for r in ref if r["chr1"] == r["chr2"]]
    missing = 42 - len(points)
    assert missing == 0
    x, y = np.array(points).T
    g, n = np.unique(np.round(x, 9), return_inverse=True)[1], None
    n = np.bincount(g)
    bx, by = np.bincount(g, x) / n, np.bincount(g, y) / n
    fit = filters.lowess(bx, by, 0.25, n=n)
    for r in got:
        if r["chr1"] == r["chr2"]:
            assert r["trend"] == pytest.approx(np.interp(r["log_distance"], bx, fit), abs=1e-6)
    threshold = filters.filter_direct(data, total, reference=wide)[1]
    assert threshold == pytest.approx(float(want))


def test_correction_for_distance_and_by_library(spark):
    data = _grid(spark, 10, 12, ("x", "y"))
    pairs, bias, changes = normalize.corrected_interactions(data, [1000, 1000], average=False, iterations=4)
    assert set(changes) == {"x", "y"} and bias.count() == 48
    for i, lib in enumerate(("x", "y")):
        alone = normalize.corrected_contacts(normalize.mean_counts(normalize.library(data, i), [1000]), data.regions, iterations=4)[0]
        want = {(r["a1"], r["a2"]): r["truth"] for r in alone.collect()}
        got = {(r["a1"], r["a2"]): r["truth"] for r in pairs.filter(F.col("lib") == lib).collect()}
        assert got == pytest.approx(want, nan_ok=True)
    one = normalize.library(data, 0)
    pairs, _, _ = normalize.corrected_interactions(one, [1000], dist_correct=True, iterations=4)
    ratio = filters.trended(one, [1_000_000], prior=0.0).filter("abundance is not null")
    ratio = {(r["a1"], r["a2"]): 2 ** (r["abundance"] - r["trend"]) for r in ratio.collect()}
    rows = pairs.collect()
    assert {(r["a1"], r["a2"]): r["mean"] for r in rows} == pytest.approx(ratio) and all(r["trend"] is not None for r in rows)


def test_compartments_against_plain_ones(spark):
    """Two checkerboard compartments on each chromosome are told apart, as by k-means on the plain residual matrix."""
    rng = np.random.default_rng(7)
    n, side = 16, lambda i: (i // 4) % 2
    cells = []
    for c in range(2):
        for a in range(n):
            for b in range(a + 1):
                mean = 300 / (1 + a - b) * (4 if side(a) == side(b) else 1)
                cells.append((c * n + a + 1, c * n + b + 1, int(rng.poisson(mean)) + 1))
    data = _set(spark, cells, [n, n], 100)
    total = [sum(c[2] for c in cells)]
    got = {r["region_id"]: r["compartment"] for r in normalize.compartments(data, total, robust=None).collect()}
    scored = [r for r in filters.trended(data, total).collect() if r["chr1"] == r["chr2"]]
    for c in range(2):
        m = np.zeros((n, n))
        for r in scored:
            if r["chr1"] == f"c{c}":
                i, j = r["a1"] - c * n - 1, r["a2"] - c * n - 1
                m[i, j] = m[j, i] = r["abundance"] - r["trend"]
        row = np.log2((2.0**m).mean(axis=1))
        m = m - row[:, None] / 2 - row[None] / 2
        labels = np.array([got[c * n + i + 1] for i in range(n)])

        def spread(part):
            return sum(((m[part == k] - m[part == k].mean(axis=0)) ** 2).sum() for k in set(part.tolist()))

        truth = np.array([side(i) for i in range(n)])
        assert spread(labels) <= spread(truth) + 1e-9
        assert (labels == labels[0]).tolist() == (truth == truth[0]).tolist()

"""The micro genome: known diagnostics, pairs, statistics, counts."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from chromaweft.functions.interval import clip_offset, reference_width
from chromaweft.operators import counts, filters, normalize, scan
from chromaweft.plans.param import PairParam
from chromaweft.sources.alignments import assign_fragments, prepare_pairs

FRAGMENTS = [(1, "chrA", 0, 1, 48), (2, "chrA", 0, 49, 94), (3, "chrA", 0, 95, 140), (4, "chrA", 0, 141, 188), (5, "chrB", 1, 1, 23), (6, "chrB", 1, 24, 69), (7, "chrB", 1, 70, 92)]

# fixed values: finished alignments as name, flag, chromosome, position, mapping quality, CIGAR
ALIGNMENTS = [
    ("good.1", 81, "chrA", 79, 200, "10M"),
    ("good.1", 129, "chrA", 9, 20, "10M"),
    ("good.2", 65, "chrA", 65, 200, "10M"),
    ("good.2", 145, "chrA", 21, 200, "10M"),
    ("good.3", 81, "chrA", 156, 200, "10M"),
    ("good.3", 145, "chrA", 6, 20, "10M"),
    ("good.4", 65, "chrA", 154, 200, "10M"),
    ("good.4", 129, "chrA", 50, 200, "10M"),
    ("good.5", 65, "chrB", 14, 200, "10M"),
    ("good.5", 145, "chrA", 105, 200, "10M"),
    ("good.6", 81, "chrB", 80, 200, "10M"),
    ("good.6", 145, "chrB", 6, 200, "10M"),
    ("self.1", 1089, "chrB", 55, 200, "10M"),
    ("self.1", 1169, "chrB", 29, 200, "10M"),
    ("singleton.1", 65, "chrB", 50, 200, "10M"),
    ("singleton.2", 129, "chrB", 50, 200, "10M"),
    ("other.1", 1089, "chrA", 169, 200, "10M"),
    ("other.1", 1153, "chrA", 144, 200, "10M"),
    ("other.2", 81, "chrB", 75, 200, "10M"),
    ("other.2", 145, "chrB", 75, 200, "10M"),
    ("dangling.1", 1089, "chrA", 121, 200, "10M"),
    ("dangling.1", 1169, "chrA", 125, 200, "10M"),
    ("dangling.2", 65, "chrB", 4, 20, "10M"),
    ("dangling.2", 145, "chrB", 11, 200, "10M"),
    ("dangling.3", 65, "chrB", 73, 20, "10M"),
    ("dangling.3", 145, "chrB", 80, 200, "10M"),
    ("dangling.4", 65, "chrB", 78, 200, "10M"),
    ("dangling.4", 145, "chrB", 75, 200, "10M"),
    ("dangling.5", 65, "chrB", 73, 200, "20M"),
    ("dangling.5", 145, "chrB", 75, 200, "10M"),
    ("good.7", 65, "chrB", 65, 200, "10M"),
    ("good.7", 145, "chrB", 11, 200, "10M"),
    ("good.8", 65, "chrB", 19, 200, "10M"),
    ("good.8", 145, "chrA", 44, 200, "10M"),
    ("self.2", 81, "chrA", 161, 200, "10M"),
    ("self.2", 129, "chrA", 184, 200, "10M"),
    ("chimeric.good.1", 65, "chrB", 65, 200, "5M5H"),
    ("chimeric.good.1", 337, "chrA", 44, 20, "5M5H"),
    ("chimeric.good.1", 129, "chrA", 19, 200, "10M"),
    ("chimeric.good.2", 1105, "chrB", 75, 200, "10M"),
    ("chimeric.good.2", 385, "chrB", 70, 200, "5H5M"),
    ("chimeric.good.2", 1153, "chrA", 136, 200, "5M5H"),
    ("chimeric.good.3", 81, "chrB", 70, 200, "5H5M"),
    ("chimeric.good.3", 337, "chrB", 65, 200, "5M5H"),
    ("chimeric.good.3", 129, "chrB", 65, 200, "5M5H"),
    ("chimeric.good.3", 385, "chrB", 70, 200, "5H5M"),
    ("chimeric.invalid.1", 1105, "chrB", 24, 200, "10H5M"),
    ("chimeric.invalid.1", 337, "chrA", 85, 200, "10M5H"),
    ("chimeric.invalid.1", 1153, "chrA", 136, 200, "5M5H"),
    ("chimeric.invalid.1", 385, "chrB", 24, 200, "5H5M"),
    ("chimeric.invalid.2", 81, "chrB", 24, 200, "5H5M"),
    ("chimeric.invalid.2", 337, "chrA", 136, 200, "5M5H"),
    ("chimeric.invalid.2", 129, "chrA", 90, 20, "5M5H"),
    ("chimeric.invalid.2", 385, "chrB", 70, 20, "5H5M"),
    ("chimeric.invalid.3", 81, "chrB", 24, 200, "5H5M"),
    ("chimeric.invalid.3", 321, "chrA", 141, 20, "5H5M"),
    ("chimeric.invalid.3", 145, "chrA", 100, 200, "10M"),
    ("chimeric.invalid.4", 81, "chrA", 141, 200, "5H5M"),
    ("chimeric.invalid.4", 1345, "chrA", 49, 200, "5H5M"),
    ("chimeric.invalid.4", 129, "chrA", 80, 200, "10M"),
    ("chimeric.invalid.5", 81, "chrA", 49, 200, "28H5M"),
    ("chimeric.invalid.5", 337, "chrB", 1, 200, "5H23M5H"),
    ("chimeric.invalid.5", 337, "chrA", 44, 200, "5M28H"),
    ("chimeric.invalid.5", 129, "chrA", 14, 200, "10M"),
    ("chimeric.invalid.6", 81, "chrA", 141, 200, "5H5M"),
    ("chimeric.invalid.6", 337, "chrA", 136, 200, "5M5H"),
    ("chimeric.invalid.6", 129, "chrA", 136, 20, "5M5H"),
    ("chimeric.invalid.6", 385, "chrA", 1, 20, "5H5M"),
    ("chimeric.invalid.7", 81, "chrB", 24, 200, "20H5M"),
    ("chimeric.invalid.7", 321, "chrA", 1, 200, "5H20M"),
    ("chimeric.invalid.7", 145, "chrA", 95, 200, "10M"),
    ("chimeric.good.4", 1089, "chrB", 14, 200, "5M5H"),
    ("chimeric.good.4", 321, "chrA", 141, 200, "5H5M"),
    ("chimeric.good.4", 1169, "chrA", 151, 200, "10M"),
    ("chimeric.good.5", 65, "chrB", 19, 200, "5M5H"),
    ("chimeric.good.5", 337, "chrA", 179, 200, "5M5H"),
    ("chimeric.good.5", 1153, "chrA", 169, 200, "10M"),
    ("unmap.1", 85, "chrA", 151, 200, "10M"),
    ("unmap.1", 129, "chrA", 19, 200, "10M"),
    ("unmap.2", 65, "chrB", 14, 200, "10M"),
    ("unmap.2", 149, "chrA", 110, 200, "10M"),
    ("unmap.3", 85, "chrB", 34, 200, "10M"),
    ("unmap.3", 149, "chrB", 6, 200, "10M"),
]

GOLDEN = {  # total, marked, filtered, mapped, dangling, self-circle, singles, chimeras, mapped, multi, invalid; rows
    "all": (dict(dedup=False), (32, 7, 3, 29, 5, 2, 2, 12, 12, 12, 7), 22),
    "default": ({}, (32, 7, 3, 22, 4, 1, 2, 12, 8, 7, 5), 17),
    "strict": (dict(ichim=False), (32, 7, 3, 22, 4, 1, 2, 12, 8, 7, 5), 12),
    "quality": (dict(minq=100), (32, 7, 9, 16, 2, 1, 2, 12, 6, 3, 2), 13),
    "near": (dict(chim_dist=20, ichim=False), (32, 7, 3, 22, 4, 1, 2, 12, 8, 7, 6), 11),
    "far": (dict(chim_dist=2000, ichim=False), (32, 7, 3, 22, 4, 1, 2, 12, 8, 7, 3), 14),
}

PAIRS = """chimeric.invalid.5 2 1 40 1 40
good.1 2 1 80 1 80
good.2 2 1 60 2 54
good.3 4 1 40 3 160
chimeric.invalid.4 4 2 20 1 66
good.4 4 2 80 0 114
chimeric.invalid.6 4 3 10 1 10
good.8 5 2 10 2 None
good.5 5 3 30 2 None
chimeric.good.1 6 1 35 0 None
chimeric.invalid.2 6 2 10 1 None
chimeric.invalid.3 6 3 20 3 None
chimeric.invalid.7 6 3 15 3 None
good.7 6 5 25 2 64
good.6 7 5 35 3 84
chimeric.good.3 7 6 10 1 10
other.2 7 7 30 3 10"""


@pytest.fixture(scope="module")
def fragments(spark):
    return spark.createDataFrame(FRAGMENTS, "frag_id int, chr string, chr_idx int, start int, end int")


@pytest.fixture(scope="module")
def reads(spark):
    return spark.createDataFrame(ALIGNMENTS, "qname string, flag int, chr string, pos int, mapq int, cigar string")


@pytest.mark.parametrize("case", list(GOLDEN))
def test_diagnostics(reads, fragments, case):
    options, totals, n = GOLDEN[case]
    pairs, found = prepare_pairs(reads, fragments, **options)
    assert tuple(found.first()) == totals
    assert pairs.count() == n


def test_pairs_and_statistics(reads, fragments):
    pairs, _ = prepare_pairs(reads, fragments)
    got = {r["qname"]: (r["anchor1_id"], r["anchor2_id"], r["length"], r["orientation"], r["insert"]) for r in scan.pair_statistics(pairs, fragments).collect()}
    want = {}
    for line in PAIRS.splitlines():
        name, *v = line.split()
        want[name] = tuple(None if x == "None" else int(x) for x in v)
    assert got == want


def test_counts_areas_and_correction(spark, reads, fragments):
    pairs, _ = prepare_pairs(reads, fragments)
    data = counts.square_counts(pairs.withColumn("lib", F.lit("x")), PairParam(fragments), ("x",), 50)
    cells = {(r["a1"], r["a2"]): r["counts"][0] for r in data.pairs.collect()}
    assert cells == {(2, 1): 3, (4, 1): 1, (4, 2): 2, (4, 3): 1, (5, 1): 1, (5, 2): 2, (5, 3): 3, (5, 5): 1, (6, 5): 2, (6, 6): 1}
    assert data.totals.first()["total"] == 17
    ends = {(r["a1"], r["a2"]): (r["area"], r["dist"]) for r in filters.with_ends(data).withColumn("area", filters.area()).withColumn("dist", filters.distance()).collect()}
    order = [(2, 1), (4, 1), (4, 2), (4, 3), (5, 1), (5, 2)]
    assert [ends[k][0] for k in order] == [2208, 2304, 2208, 2208, 3312, 3174]
    assert [ends[k][1] for k in order] == [47, 140, 93, 47, None, None]
    truth = {(r["a1"], r["a2"]): r["truth"] for r in normalize.corrected_contacts(normalize.mean_counts(data, [17]), data.regions, iterations=50)[0].collect()}
    want = [15170.32, 0.6123523, 0.6123523, 0.8162749, 0.2041633, 0.2041633]
    assert [truth[k] for k in order] == pytest.approx(want, rel=1e-5)


def test_cigar(spark):
    table = [("5H20M", 20, 5, 0), ("5H20M6H", 20, 5, 6), ("20M5I30M", 50, 0, 0), ("20M5D30M", 55, 0, 0), ("20M5N30M", 55, 0, 0), ("20M5X30M", 55, 0, 0), ("5S19M34=55D8X20M6S", 136, 0, 0), ("*", 0, 0, 0)]
    df = spark.createDataFrame(table, "c string, w int, f int, r int")
    for row in df.select("*", reference_width(F.col("c")).alias("gw"), clip_offset(F.col("c"), F.lit(False)).alias("gf"), clip_offset(F.col("c"), F.lit(True)).alias("gr")).collect():
        assert (row["gw"], row["gf"], row["gr"]) == (row["w"], row["f"], row["r"])


def test_fragment_lookup_with_overlaps(spark):
    starts, ends = [1, 100, 200, 300, 400, 500], [103, 203, 303, 403, 503, 1000]
    frag = spark.createDataFrame([(i + 1, "c", 0, s, e) for i, (s, e) in enumerate(zip(starts, ends))], "frag_id int, chr string, chr_idx int, start int, end int")
    reads = [(94 + 9, True, 1), (95 + 9, True, 2), (99, False, 1), (100, False, 2), (203, True, 2), (204, True, 3), (209, False, 3), (300, False, 4), (1001, True, 6), (992, False, 6)]
    df = spark.createDataFrame([("c", *r) for r in reads], "chr string, five int, reverse boolean, want int")
    assert all(r["frag_id"] == r["want"] for r in assign_fragments(df, frag).collect())


def test_fragment_lookup_of_many_fragments(spark):
    """Dense and sparse chromosomes, overlapping fragments, reads beyond the ends and on an unknown chromosome, against plain code."""
    rng = random.Random(5)
    cut = {}
    for chrom, n, width in (("c", 3000, 8), ("d", 40, 90_000), ("e", 1, 50)):
        at, cut[chrom] = rng.randint(1, 1000), []
        for _ in range(n):
            end = at + rng.randint(width // 2, width)
            cut[chrom].append((sum(map(len, cut.values())) + 1, at, end))
            at = end + 1 - rng.choice((0, 2, 4))
    rows = [(k, chrom, i, a, b) for i, chrom in enumerate(cut) for k, a, b in cut[chrom]]
    frag = spark.createDataFrame(rows, "frag_id int, chr string, chr_idx int, start int, end int")

    def plain(chrom, five, reverse):
        if reverse:
            return next((k for k, _, b in cut[chrom] if b >= five), cut[chrom][-1][0])
        return next((k for k, a, _ in reversed(cut[chrom]) if a <= five), cut[chrom][0][0])

    reads = [("x", 5, True, None)]
    for chrom, parts in cut.items():
        for _ in range(500):
            five, reverse = rng.randint(parts[0][1] - 60, parts[-1][2] + 60), rng.random() < 0.5
            reads.append((chrom, five, reverse, plain(chrom, five, reverse)))
    found = assign_fragments(spark.createDataFrame(reads, "chr string, five int, reverse boolean, want int"), frag)
    got = found.collect()
    assert len(got) == len(reads) and all(r["frag_id"] == r["want"] for r in got)
    # a frame up to the last row is summed anew for each row, which takes the square of a chromosome's fragments
    assert "unboundedfollowing" not in found._jdf.queryExecution().toString().lower()


def test_pairing_without_a_task_per_chromosome(spark, reads, fragments):
    """Reads are dealt by place and by name, never by chromosome alone, and a name's segments are not collected."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs, totals = prepare_pairs(reads, fragments)
        for df in (pairs, totals):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "collect_list" not in plan and not re.search(r"SortMergeJoin \[chr#\d+\], ", plan)
        assert tuple(totals.first()) == GOLDEN["default"][1]
        assert pairs.count() == GOLDEN["default"][2]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_segments_of_a_name(spark, fragments):
    """A second segment is the last of two; three are invalid in any order; equal ones count each."""
    first = [("a", 65, "chrA", 1, 60, "10M"), ("a", 145, "chrA", 130, 60, "10M")]
    two = first + [("a", 321, "chrA", 120, 60, "5H5M")]  # not hanging over: clipped by 5 forward, faces the mate on fragment 3
    far = first + [("a", 321, "chrA", 60, 60, "5H5M")]
    three = two + [("a", 321, "chrA", 121, 60, "6H4M")]
    twice = first + [("a", 321, "chrA", 120, 60, "5H5M")] * 2
    for rows, invalid in ((first, 0), (two, 0), (far, 1), (three, 1), (three[::-1], 1), (twice, 1)):
        df = spark.createDataFrame(rows, "qname string, flag int, chr string, pos int, mapq int, cigar string")
        pairs, totals = prepare_pairs(df, fragments, ichim=False)
        got = totals.first()
        assert (got["total"], got["mapped"], got["chimeras_multi"], got["chimeras_invalid"]) == (1, 1, int(len(rows) > 2), invalid)
        assert pairs.count() == 1 - invalid


def test_clip_offset_costs_no_more_than_the_width(spark):
    """A cast that throws and catches for each read without a clip cost ten times the width."""
    n = 1_000_000
    df = spark.range(n).select(F.concat((F.col("id") % 90 + 10).cast("string"), F.lit("M")).alias("c"), (F.col("id") % 2 == 0).alias("r"))

    def seconds(x):
        took = []
        for _ in range(2):
            began = time.perf_counter()
            assert df.select(x.alias("x")).agg(F.sum("x")).first()[0] is not None
            took.append(time.perf_counter() - began)
        return min(took)

    assert seconds(clip_offset(F.col("c"), F.col("r"))) < 3 * seconds(reference_width(F.col("c")))
    odd = [("99999999999H10M", 0), ("H10M", 0), ("", 0), (None, 0), ("07H3M", 7)]
    rows = spark.createDataFrame(odd, "c string, want int").withColumn("got", clip_offset(F.col("c"), F.lit(False)))
    assert all(r["got"] == r["want"] for r in rows.collect())

"""Stores, matrices, digests, streams, small cases."""

import re

import pytest
from pyspark.sql import functions as F

from chromaweft.functions.abundance import abundance
from chromaweft.operators import counts, filters, results
from chromaweft.plans import demo
from chromaweft.plans.param import Interactions, PairParam
from chromaweft.sources import alignments, genome, matrices, store
from chromaweft.streaming.incremental import run_to_store, run_to_table, stored_counts, stream_store, streaming_counts

SF = "/root/testdata/sf0.001"


def test_param():
    with pytest.raises(ValueError):
        PairParam()
    with pytest.raises(ValueError):
        PairParam(fragments=object(), cap=0)
    p = PairParam(fragments=object(), restrict=("a",))
    assert p.reform(cap=3).cap == 3 and p.cap is None and "restrict=('a',)" in repr(p)


def test_swap_takes_extra_columns_along(spark):
    df = spark.createDataFrame([("x", "a", "b", 1, 2, 10, 20, 5, -5, "p", "q")], "lib string, chr1 string, chr2 string, anchor1_id int, anchor2_id int, anchor1_pos int, anchor2_pos int, anchor1_len int, anchor2_len int, note1 string, note2 string")
    row = store.order_ends(df).first()
    assert (row["chr1"], row["chr2"], row["anchor1_id"], row["anchor1_pos"], row["anchor1_len"], row["note1"]) == ("b", "a", 2, 20, -5, "q")


def test_missing_chromosome_pair_is_an_error(spark):
    with pytest.raises(ValueError):
        store.load_pair(demo.pairs(spark, SF), "chr1", "nowhere")


def test_old_names(spark):
    df = spark.createDataFrame([(1, 2)], "`anchor.id` int, target_pos int")
    assert store.modern_names(df).columns == ["anchor1_id", "anchor2_pos"]


def test_sam(spark, tmp_path):
    (tmp_path / "x.sam").write_text("@SQ\tSN:a\tLN:9\nr1\t65\ta\t3\t60\t5M\t*\t0\t0\tN\th\n")
    row = alignments.read_sam(spark, str(tmp_path / "x.sam")).first()
    assert tuple(row) == ("r1", 65, "a", 3, 60, "5M")


def _brute_cut(seq, pattern, overhang):
    rem = (len(pattern) - overhang) // 2
    regex = "".join(f"[{genome.IUPAC[c]}]" for c in pattern)
    out, start = [], 1
    for m in re.finditer(f"(?={regex})", seq):
        p = m.start() + 1
        out.append((start, p + rem - 1 + overhang))
        start = p + rem
    return [*out, (start, len(seq))]


@pytest.mark.parametrize("pattern,overhang", [("GATC", 4), ("GCGC", 2), ("ACNGT", 3), ("AACGTT", 2), ("GGATCC", 4)])
def test_digest(spark, tmp_path, pattern, overhang):
    import random

    rng = random.Random(5)
    seqs = {c: "".join(rng.choice(["GATC", "GCGC", "ACAGT", "AACGTT", "GGATCC", "A", "C", "G", "T"]) for _ in range(400)) for c in ("x", "y")}
    seqs["z"] = "AAAA"
    (tmp_path / "g.fa").write_text("".join(f">{c} note\n{s[:50]}\n{s[50:]}\n" for c, s in seqs.items()))
    df = genome.read_fasta(spark, str(tmp_path / "g.fa"))
    assert {r["chr"]: r["length"] for r in genome.empty_genome(df).collect()} == {c: len(s) for c, s in seqs.items()}
    got = [(r["chr"], r["start"], r["end"]) for r in genome.cut_genome(df, [pattern], overhang, piece=97).orderBy("frag_id").collect()]
    assert got == [(c, *x) for c, s in seqs.items() for x in sorted(_brute_cut(s, pattern, overhang))]


def test_digest_with_two_enzymes_and_errors(spark):
    df = spark.createDataFrame([("x", 0, "AAGATCAAGCGCAAGATC")], "chr string, chr_idx int, seq string")
    got = [(r["start"], r["end"]) for r in genome.cut_genome(df, ["GATC", "GCGC"], [4, 2]).orderBy("frag_id").collect()]
    assert got == [(1, 6), (3, 11), (10, 18), (15, 18)]
    for pattern, overhang in (("GATT", 4), ("GATC", 5), ("GATC", 3)):
        with pytest.raises(ValueError):
            genome.cut_genome(df, [pattern], overhang)


def test_mtx(spark, tmp_path):
    (tmp_path / "r.bed").write_text("b\t0\t10\na\t10\t20\na\t0\t10\n")
    (tmp_path / "1.mtx").write_text("%%MatrixMarket\n% note\n3 3 4\n1 1 5\n1 3 2\n3 1 7\n2 3 1\n")
    (tmp_path / "2.mtx").write_text("%%MatrixMarket\n3 3 1\n2 2 4\n")
    data = matrices.read_mtx(spark, [str(tmp_path / "1.mtx"), str(tmp_path / "2.mtx")], str(tmp_path / "r.bed"))
    assert {(r["a1"], r["a2"]): list(r["counts"]) for r in data.pairs.collect()} == {(3, 3): [5, 0], (3, 1): [7, 0], (2, 1): [1, 0], (2, 2): [0, 4]}
    assert {r["lib"]: r["total"] for r in data.totals.collect()} == {"0": 13, "1": 4} and data.width == 10
    (tmp_path / "3.mtx").write_text("4 4 0\n")
    with pytest.raises(ValueError):
        matrices.read_mtx(spark, [str(tmp_path / "3.mtx")], str(tmp_path / "r.bed"))


def test_abundance_constants(spark):
    def at(y, prior=2.0, scale=1.0):
        return spark.range(1).select(abundance(F.array(F.lit(y)), [1_000_000], prior, scale).alias("a")).first()["a"]

    assert at(10) == pytest.approx(3.584957, abs=1e-5)
    assert at(10, 5.0) == pytest.approx(3.906876, abs=1e-5)
    assert at(100) == pytest.approx(6.67242, abs=1e-5)
    assert at(0) == pytest.approx(0.9999942, abs=1e-6)
    assert at(40, scale=4.0) == pytest.approx(at(10))
    two = spark.range(1).select(abundance(F.array(F.lit(10), F.lit(10)), [1_000_000, 1_000_000]).alias("a")).first()["a"]
    assert two == pytest.approx(at(10), abs=1e-6)


def test_empty_pairs(spark):
    pairs = demo.pairs(spark, SF).filter("false")
    param = demo.param(spark, SF)
    data = counts.square_counts(pairs, param, ("A",), 5000)
    assert data.pairs.count() == 0 and data.totals.first()["total"] == 0
    assert counts.margin_counts(pairs, param, ("A",), 5000).agg(F.sum(F.get("counts", F.lit(0)))).first()[0] == 0
    assert counts.domain_directions(pairs, param, ("A",), 5000).count() == data.regions.count()


def test_fragment_area_and_negative_width(spark):
    with pytest.raises(ValueError):
        counts.fragment_bins(demo.fragments(spark, SF), -1)
    regions = spark.createDataFrame([(1, "a", 0, 1, 100, 4)], "region_id long, chr string, chr_idx int, start int, end int, nfrags long")
    pairs = spark.createDataFrame([(1, 1)], "a1 long, a2 long")
    ends = filters.with_ends(Interactions(pairs, regions, (), pairs))
    assert ends.select(filters.area(False).alias("x")).first()["x"] == 10


def test_split_clusters(spark):
    rows = [(i, "a", 1 + 100 * i, 100 + 100 * i, "a", 1, 100) for i in range(10)]
    boxes = spark.createDataFrame(rows, "box_id long, chr1 string, start1 int, end1 int, chr2 string, start2 int, end2 int")
    got = {r["box_id"]: r["cluster_id"] for r in results.cluster_boxes(boxes, tol=1, upper=500).collect()}
    assert len(set(got.values())) == 2 and got[0] == got[4] and got[5] == got[9]
    assert len({r["cluster_id"] for r in results.cluster_boxes(boxes, tol=0, upper=None).collect()}) == 10


def test_streaming_counts_match_batch(spark, tmp_path):
    path = str(tmp_path / "store")
    store.save_pairs(demo.pairs(spark, SF), path)
    bins = counts.fragment_bins(demo.fragments(spark, SF), demo.WIDTH)
    run_to_table(streaming_counts(stream_store(spark, path), bins), "live", str(tmp_path / "state")).awaitTermination()
    batch = streaming_counts(store.load_store(spark, path), bins)
    live = spark.table("live")
    assert live.count() and live.exceptAll(batch).count() == 0 and batch.exceptAll(live).count() == 0


def test_streaming_counts_in_a_store(spark, tmp_path):
    path, out, state = (str(tmp_path / x) for x in ("store", "out", "state"))
    bins = counts.fragment_bins(demo.fragments(spark, SF), 5000)
    pairs = demo.pairs(spark, SF)
    store.save_pairs(pairs.filter("lib = 'A'"), path)
    run_to_store(stream_store(spark, path, 2), bins, out, state).awaitTermination()
    store.save_pairs(pairs.filter("lib <> 'A'"), path, mode="append")
    run_to_store(stream_store(spark, path, 2), bins, out, state).awaitTermination()
    batch = streaming_counts(store.load_store(spark, path), bins)
    live = stored_counts(spark, out)
    assert live.count() and live.exceptAll(batch).count() == 0 and batch.exceptAll(live).count() == 0

"""Queries over the driver's tables, one or more per operator, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chromaweft.functions.abundance import abundance
from chromaweft.functions.interval import clip_offset, five_prime, merge_ranges, reference_width
from chromaweft.operators import counts, filters, geometry, neighbors, normalize, results
from chromaweft.operators import scan as scans
from chromaweft.plans import demo
from chromaweft.plans.durable import durable, scratch_path
from chromaweft.plans.param import Interactions, PairParam
from chromaweft.sources import alignments, genome, matrices, store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
LIBS = demo.LIBRARIES
SLOTS = ", ".join(f"count(*) FILTER (lib = '{x}') AS c_{x}" for x in LIBS)


def query(sql: str | None = None, with_demo: bool = True):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = f"WITH {demo.SQL}{sql}" if with_demo else sql
        return f

    return add


def slots(df: DataFrame, column: str = "counts", prefix: str = "c_") -> DataFrame:
    return df.select(*[c for c in df.columns if c != column], *[F.get(column, F.lit(i)).cast("long").alias(f"{prefix}{x}") for i, x in enumerate(LIBS)])


def _square(spark, sf_dir, near=False, least=1, **more) -> Interactions:
    return counts.square_counts(demo.pairs(spark, sf_dir, near), demo.param(spark, sf_dir, **more), LIBS, demo.WIDTH, least)


def _totals(data: Interactions) -> list[int]:
    found = {r["lib"]: r["total"] for r in data.totals.collect()}  # a number per library
    return [found.get(x, 0) for x in data.libraries]


_CELLS = f", cells AS (SELECT a.bin AS a1, b.bin AS a2, {SLOTS}, count(*) AS total FROM pairs p JOIN bin a ON a.frag_id = p.id1 JOIN bin b ON b.frag_id = p.id2 GROUP BY ALL)"
_NEAR = _CELLS.replace("FROM pairs p", "FROM near p")
_ENDS = ", ends AS (SELECT c.*, r.chr AS chr1, r.s AS s1, r.e AS e1, r.nfrags AS nf1, q.chr AS chr2, q.s AS s2, q.e AS e2, q.nfrags AS nf2 FROM cells c JOIN reg r ON r.region_id = a1 JOIN reg q ON q.region_id = a2)"


# ---- scan -------------------------------------------------------------------------------------------------


@query(" SELECT lib, chr1, chr2, count(*) AS n, sum(pos1) AS p1, sum(pos2) AS p2 FROM pairs WHERE chr1 IN ('chr1', 'chr3') AND chr2 IN ('chr1', 'chr3') GROUP BY ALL")
def f1_restrict(spark, sf_dir):
    return _summed(scans.scan(demo.pairs(spark, sf_dir), demo.param(spark, sf_dir, restrict=("chr1", "chr3"))))


@query(" SELECT lib, chr1, chr2, count(*) AS n, sum(pos1) AS p1, sum(pos2) AS p2 FROM pairs WHERE (chr1, chr2) IN (('chr2', 'chr1'), ('chr4', 'chr3')) GROUP BY ALL")
def f2_restrict_pairs(spark, sf_dir):
    return _summed(scans.scan(demo.pairs(spark, sf_dir), demo.param(spark, sf_dir, restrict=(("chr1", "chr2"), ("chr4", "chr3")))))


def _summed(df):
    return df.groupBy("lib", "chr1", "chr2").agg(F.count(F.lit(1)).alias("n"), F.sum("anchor1_pos").alias("p1"), F.sum("anchor2_pos").alias("p2"))


_DISCARD = ", disc AS (SELECT chr, s AS ds, s + 699 AS de FROM frag WHERE frag_id % 7 = 0 UNION ALL SELECT chr, s + 700, s + 1400 FROM frag WHERE frag_id % 14 = 0)"
_ISLANDS = ", isl AS (SELECT chr, min(ds) AS ds, max(de) AS de FROM (SELECT *, sum(new) OVER (PARTITION BY chr ORDER BY ds, de) AS g FROM (SELECT *, CASE WHEN ds <= max(de) OVER (PARTITION BY chr ORDER BY ds, de ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS new FROM disc)) GROUP BY chr, g)"
_IN = "EXISTS (SELECT 1 FROM isl WHERE isl.chr = chr{i} AND pos{i} >= ds AND pos{i} + abs(len{i}) - 1 <= de)"


def _discard(spark, sf_dir):
    f = demo.fragments(spark, sf_dir)
    a = f.filter("frag_id % 7 = 0").select("chr", "start", (F.col("start") + 699).alias("end"))
    return a.union(f.filter("frag_id % 14 = 0").select("chr", (F.col("start") + 700).alias("start"), (F.col("start") + 1400).alias("end")))


@query(f"{_DISCARD}{_ISLANDS} SELECT lib, chr1, chr2, count(*) AS n, sum(pos1) AS p1, sum(pos2) AS p2 FROM pairs WHERE NOT {_IN.format(i=1)} AND NOT {_IN.format(i=2)} GROUP BY ALL")
def f3_discard(spark, sf_dir):
    return _summed(scans.scan(demo.pairs(spark, sf_dir), demo.param(spark, sf_dir, discard=_discard(spark, sf_dir))))


@query(f"{_DISCARD}{_ISLANDS} SELECT chr, ds AS start, de AS \"end\" FROM isl")
def w2_merge_ranges(spark, sf_dir):
    return merge_ranges(_discard(spark, sf_dir))


_RANKED = ", ranked AS (SELECT *, row_number() OVER (PARTITION BY lib, id1, id2 ORDER BY pos1, pos2, len1, len2) AS k FROM near)"


@query(f"{_RANKED} SELECT lib, chr1, chr2, count(*) AS n, sum(pos1) AS p1, sum(pos2) AS p2 FROM ranked WHERE k <= 2 GROUP BY ALL")
def f4_cap(spark, sf_dir):
    return _summed(scans.scan(demo.pairs(spark, sf_dir, near=True), demo.param(spark, sf_dir, cap=2)))


@query(" SELECT count(*) AS n_pairs, count(*) FILTER (id1 < id2) AS wrong_order, CAST(0 AS BIGINT) AS unknown_fragment, CAST(0 AS BIGINT) AS wrong_chromosome, CAST(0 AS BIGINT) AS unknown_chromosome FROM pairs")
def f5_check(spark, sf_dir):
    return scans.check_pairs(demo.pairs(spark, sf_dir), demo.fragments(spark, sf_dir))


_STATS = ", stats AS (SELECT p.*, CASE WHEN len1 < 0 THEN pos1 - len1 - a.s ELSE a.e - pos1 + 1 END + CASE WHEN len2 < 0 THEN pos2 - len2 - b.s ELSE b.e - pos2 + 1 END AS length, CASE WHEN len1 < 0 THEN 1 ELSE 0 END + CASE WHEN len2 < 0 THEN 2 ELSE 0 END AS orientation, CASE WHEN chr1 = chr2 THEN greatest(pos1 + abs(len1), pos2 + abs(len2)) - least(pos1, pos2) END AS ins FROM near p JOIN frag a ON a.frag_id = id1 JOIN frag b ON b.frag_id = id2)"


@query(f"{_STATS} SELECT lib, id1 AS anchor1_id, id2 AS anchor2_id, CAST(length AS BIGINT) AS length, CAST(orientation AS BIGINT) AS orientation, CAST(ins AS BIGINT) AS insert_size FROM stats")
def f6_pair_data(spark, sf_dir):
    out = scans.pair_statistics(demo.pairs(spark, sf_dir, near=True), demo.fragments(spark, sf_dir))
    return out.select("lib", F.col("anchor1_id").cast("long").alias("anchor1_id"), F.col("anchor2_id").cast("long").alias("anchor2_id"), F.col("length").cast("long").alias("length"), F.col("orientation").cast("long").alias("orientation"), F.col("insert").cast("long").alias("insert_size"))


@query(
    f"""{_STATS}, marks AS (SELECT *, length > 2500 AS l, coalesce(chr1 = chr2 AND orientation = 1 AND ins < 3000, false) AS i, coalesce(chr1 = chr2 AND orientation = 2 AND ins < 9000, false) AS o FROM stats),
    capped AS (SELECT *, NOT (l OR i OR o) AS ok, row_number() OVER (PARTITION BY lib, id1, id2, NOT (l OR i OR o) ORDER BY pos1, pos2, len1, len2) AS k FROM marks)
    SELECT count(*) FILTER (NOT (ok AND k > 3)) AS total, count(*) FILTER (l) AS length, count(*) FILTER (i) AS inward, count(*) FILTER (o) AS outward, count(*) FILTER (ok AND k <= 3) AS retained FROM capped"""
)
def s5_prune_pairs(spark, sf_dir):
    return scans.prune_pairs(demo.pairs(spark, sf_dir, near=True), demo.param(spark, sf_dir, cap=3), 2500, 3000, 9000)[1]


@query(
    f"""{_STATS}, marks AS (SELECT *, length > 2500 OR coalesce(chr1 = chr2 AND orientation = 1 AND ins < 3000, false) OR coalesce(chr1 = chr2 AND orientation = 2 AND ins < 9000, false) AS bad FROM stats),
    capped AS (SELECT *, row_number() OVER (PARTITION BY lib, id1, id2 ORDER BY pos1, pos2, len1, len2) AS k FROM marks WHERE NOT bad)
    SELECT lib, id1 AS anchor1_id, id2 AS anchor2_id, CAST(pos1 AS BIGINT) AS anchor1_pos, CAST(pos2 AS BIGINT) AS anchor2_pos, CAST(len1 AS BIGINT) AS anchor1_len, CAST(len2 AS BIGINT) AS anchor2_len FROM capped WHERE k <= 3"""
)
def s5_pruned_store(spark, sf_dir):
    path = scratch_path(spark, "store")
    store.save_pairs(demo.pairs(spark, sf_dir, near=True), path)
    store.prune_store(spark, path, demo.param(spark, sf_dir, cap=3), None, 2500, 3000, 9000)
    return store.load_store(spark, path).select("lib", *[F.col(c).cast("long").alias(c) for c in scans.STORED])


def _stored(spark, sf_dir) -> str:
    """A store written with its ends the wrong way round for every other pair."""
    path = scratch_path(spark, "store")
    p = demo.pairs(spark, sf_dir)
    odd = (F.col("anchor1_pos") % 2 == 1) & (F.col("anchor1_id") > F.col("anchor2_id"))
    mixed = [F.when(odd, F.col(c.replace("1", "2") if "1" in c else c.replace("2", "1"))).otherwise(F.col(c)).alias(c) for c in p.columns]
    store.save_pairs(p.select(*mixed), path)
    return path


@query(" SELECT lib, chr1, chr2, count(*) AS n, sum(pos1) AS p1, sum(pos2) AS p2 FROM pairs GROUP BY ALL")
def s3_save_and_load(spark, sf_dir):
    return _summed(store.load_store(spark, _stored(spark, sf_dir)))


@query(" SELECT lib, chr1, chr2, 2 * count(*) AS n, 2 * sum(pos1) AS p1, 2 * sum(pos2) AS p2 FROM pairs GROUP BY ALL")
def s4_merge_pairs(spark, sf_dir):
    path = _stored(spark, sf_dir)
    both = scratch_path(spark, "store")
    store.merge_stores(spark, [path, path], both)
    store.merge_stores(spark, [both], both)  # the result may replace an input
    return _summed(store.load_store(spark, both))


@query(" SELECT DISTINCT chr1, chr2 FROM pairs")
def s6_chromosome_pairs(spark, sf_dir):
    return store.chromosome_pairs(demo.pairs(spark, sf_dir))


@query(" SELECT lib, chr1, chr2, count(*) AS n, sum(pos1) AS p1, sum(pos2) AS p2 FROM pairs WHERE chr1 = 'chr2' AND chr2 = 'chr1' GROUP BY ALL")
def s7_load_pair(spark, sf_dir):
    return _summed(store.load_pair(demo.pairs(spark, sf_dir), "chr1", "chr2")[0])


@query(" SELECT count(*) AS n_pairs, count(*) FILTER (pos1 % 5 = 0 AND id1 <> id2) AS wrong_order, count(*) FILTER (pos1 % 5 = 1) AS unknown_fragment, count(*) FILTER ((pos1 % 5 = 2 AND chr1 <> 'chr1') OR pos1 % 5 = 3) AS wrong_chromosome, count(*) FILTER (pos1 % 5 = 3) AS unknown_chromosome FROM pairs")
def f5_check_violations(spark, sf_dir):
    p, kind = demo.pairs(spark, sf_dir), F.col("anchor1_pos") % 5
    swap = [F.when(kind == 0, F.col(b)).otherwise(F.col(a)).alias(a) for a, b in (("anchor1_id", "anchor2_id"), ("anchor2_id", "anchor1_id"), ("chr1", "chr2"), ("chr2", "chr1"))]
    bad = p.select("anchor1_pos", *swap).withColumn("anchor1_id", F.when(kind == 1, 10_000_000).otherwise(F.col("anchor1_id"))).withColumn("chr1", F.when(kind == 2, "chr1").otherwise(F.col("chr1"))).withColumn("chr2", F.when(kind == 3, "chrX").otherwise(F.col("chr2")))
    return scans.check_pairs(bad, demo.fragments(spark, sf_dir))


# ---- counts -----------------------------------------------------------------------------------------------


@query(f"{_CELLS} SELECT a1, a2, {', '.join('c_' + x for x in LIBS)} FROM cells WHERE total >= 5")
def a1_square_counts(spark, sf_dir):
    return slots(_square(spark, sf_dir, least=5).pairs)


@query(" SELECT region_id, chr, s AS start, e AS \"end\", nfrags FROM reg")
def a12_bins(spark, sf_dir):
    bins = counts.fragment_bins(demo.fragments(spark, sf_dir), demo.WIDTH)
    return counts.bin_regions(bins).select("region_id", "chr", "start", "end", "nfrags")


@query(f"{_DISCARD}{_ISLANDS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY lib, id1, id2 ORDER BY pos1, pos2, len1, len2) AS k FROM near WHERE chr1 IN ('chr1', 'chr2') AND chr2 IN ('chr1', 'chr2') AND NOT {_IN.format(i=1)} AND NOT {_IN.format(i=2)}) SELECT a.bin AS a1, b.bin AS a2, {SLOTS} FROM ranked p JOIN bin a ON a.frag_id = p.id1 JOIN bin b ON b.frag_id = p.id2 WHERE k <= 2 GROUP BY ALL HAVING count(*) >= 3")
def a1_square_counts_filtered(spark, sf_dir):
    return slots(_square(spark, sf_dir, near=True, least=3, restrict=("chr1", "chr2"), discard=_discard(spark, sf_dir), cap=2).pairs)


@query(f"{_RANKED} SELECT x.lib, (SELECT count(*) FROM ranked r WHERE r.lib = x.lib AND k <= 2) AS total FROM (VALUES ('A'), ('N'), ('R'), ('Z')) x(lib)")
def a4_total_counts(spark, sf_dir):
    return counts.total_counts(demo.pairs(spark, sf_dir, near=True), demo.param(spark, sf_dir, cap=2), (*LIBS, "Z"))


@query(f", e AS (SELECT lib, a.bin FROM pairs p JOIN bin a ON a.frag_id = p.id1 UNION ALL SELECT lib, b.bin FROM pairs p JOIN bin b ON b.frag_id = p.id2) SELECT region_id, chr, {', '.join(f'(SELECT count(*) FROM e WHERE e.bin = region_id AND lib = {chr(39)}{x}{chr(39)}) AS c_{x}' for x in LIBS)} FROM reg")
def a3_margin_counts(spark, sf_dir):
    out = counts.margin_counts(demo.pairs(spark, sf_dir), demo.param(spark, sf_dir), LIBS, demo.WIDTH)
    return slots(out.select("region_id", "chr", "counts"))


_TWO_CHROMOSOMES = ", b2 AS (SELECT *, dense_rank() OVER (ORDER BY chr_idx, raw) AS nb FROM bin0 WHERE chr IN ('chr2', 'chr4'))"


@query(f"{_TWO_CHROMOSOMES}, e AS (SELECT lib, a.nb FROM pairs p JOIN b2 a ON a.frag_id = p.id1 JOIN b2 b ON b.frag_id = p.id2 UNION ALL SELECT lib, b.nb FROM pairs p JOIN b2 a ON a.frag_id = p.id1 JOIN b2 b ON b.frag_id = p.id2) SELECT nb AS region_id, any_value(chr) AS chr, {', '.join(f'(SELECT count(*) FROM e WHERE e.nb = b2.nb AND lib = {chr(39)}{x}{chr(39)}) AS c_{x}' for x in LIBS)} FROM b2 GROUP BY nb")
def a3_margin_counts_restricted(spark, sf_dir):
    out = counts.margin_counts(demo.pairs(spark, sf_dir), demo.param(spark, sf_dir, restrict=("chr2", "chr4")), LIBS, demo.WIDTH, restrict_regions=True)
    return slots(out.select("region_id", "chr", "counts"))


@query(f"{_NEAR}{_ENDS} SELECT region_id, " + ", ".join(f"CAST(coalesce((SELECT sum(c_{x}) FROM ends WHERE {mine} = region_id AND chr1 = chr2 AND a1 - a2 BETWEEN 1 AND 3), 0) AS BIGINT) AS {side}_{x}" for side, mine in (("up", "a2"), ("down", "a1")) for x in LIBS) + " FROM reg")
def a5_domain_directions(spark, sf_dir):
    out = counts.domain_directions(demo.pairs(spark, sf_dir, near=True), demo.param(spark, sf_dir), LIBS, demo.WIDTH, span=3)
    return slots(slots(out.select("region_id", "up", "down"), "up", "up_"), "down", "down_")


_PATCH = " SELECT a1, a2, total AS count, NOT (chr1 = 'chr1' AND s1 <= 300000 AND e1 >= 1 AND chr2 = 'chr1' AND s2 <= 900000 AND e2 >= 200000) AS flipped FROM ends WHERE chr1 = 'chr1' AND chr2 = 'chr1' AND ((s1 <= 300000 AND e1 >= 1 AND s2 <= 900000 AND e2 >= 200000) OR (s2 <= 300000 AND e2 >= 1 AND s1 <= 900000 AND e1 >= 200000))"


@query(f"{_CELLS}{_ENDS}{_PATCH}")
def a2_extract_patch(spark, sf_dir):
    return counts.extract_patch(demo.pairs(spark, sf_dir), demo.param(spark, sf_dir), ("chr1", 1, 300000), ("chr1", 200000, 900000), demo.WIDTH)


@query(f"{_TWO_CHROMOSOMES}, rb AS (SELECT nb, min(chr) AS chr, min(s) AS s, max(e) AS e FROM b2 GROUP BY nb), c AS (SELECT a.nb AS a1, b.nb AS a2, count(*) AS count FROM pairs p JOIN b2 a ON a.frag_id = p.id1 JOIN b2 b ON b.frag_id = p.id2 GROUP BY 1, 2) SELECT a1, a2, count, x.chr <> 'chr2' AS flipped FROM c JOIN rb x ON x.nb = a1 JOIN rb y ON y.nb = a2 WHERE x.chr = 'chr4' AND y.chr = 'chr2' AND y.s <= 400000 AND y.e >= 100000 AND x.s <= 500000 AND x.e >= 50000")
def a2_extract_patch_restricted(spark, sf_dir):
    """Between chromosomes, asked for the other way round than they are stored, over their bins alone."""
    return counts.extract_patch(demo.pairs(spark, sf_dir), demo.param(spark, sf_dir), ("chr2", 100000, 400000), ("chr4", 50000, 500000), demo.WIDTH, restrict_regions=True)


_LEN = ", lens AS (SELECT chr, chr_idx, max(e) AS len FROM frag GROUP BY ALL), dn AS (SELECT *, sum(nb) OVER (ORDER BY chr_idx) - nb AS shift FROM (SELECT *, ceil(len * 1.0 / (SELECT width FROM n)) AS nb FROM lens))"
_BIN5 = "CAST(d{i}.shift + ceil((CASE WHEN len{i} < 0 THEN least(pos{i} - len{i} - 1, d{i}.len) ELSE pos{i} END) * 1.0 / (SELECT width FROM n)) AS BIGINT)"


def _lengths(spark, sf_dir):
    return durable(demo.fragments(spark, sf_dir).groupBy("chr", "chr_idx").agg(F.max("end").alias("length")))


@query(f"{_LEN}, b AS (SELECT lib, {_BIN5.format(i=1)} AS x, {_BIN5.format(i=2)} AS y FROM pairs JOIN dn d1 ON d1.chr = chr1 JOIN dn d2 ON d2.chr = chr2) SELECT greatest(x, y) AS a1, least(x, y) AS a2, {SLOTS} FROM b GROUP BY 1, 2")
def a1_square_counts_dnase(spark, sf_dir):
    param = PairParam(chromosomes=_lengths(spark, sf_dir))
    return slots(counts.square_counts(demo.pairs(spark, sf_dir), param, LIBS, demo.WIDTH).pairs)


_NB = """, placed AS (SELECT c.*, r.chr_idx AS c1, q.chr_idx AS c2, a1 - r.f AS rw, a2 - q.f AS cl, r.sz AS n1, q.sz AS n2 FROM cells c
  JOIN (SELECT x.region_id, x.chr_idx, f, sz FROM reg x JOIN (SELECT chr_idx, min(region_id) AS f, count(*) AS sz FROM reg GROUP BY 1) USING (chr_idx)) r ON r.region_id = a1
  JOIN (SELECT x.region_id, x.chr_idx, f, sz FROM reg x JOIN (SELECT chr_idx, min(region_id) AS f, count(*) AS sz FROM reg GROUP BY 1) USING (chr_idx)) q ON q.region_id = a2),
grid AS (SELECT a.chr_idx AS c1, b.chr_idx AS c2, x.i AS rw, y.i AS cl FROM (SELECT chr_idx, count(*) AS sz FROM reg GROUP BY 1) a JOIN (SELECT chr_idx, count(*) AS sz FROM reg GROUP BY 1) b ON a.chr_idx >= b.chr_idx, LATERAL (SELECT unnest(range(a.sz)) AS i) x, LATERAL (SELECT unnest(range(b.sz)) AS i) y WHERE a.chr_idx <> b.chr_idx OR y.i <= x.i)"""
_SHAPES = {
    "quadrant": ("p.c1 = p.c2 AND q.rw BETWEEN p.rw - 2 AND p.rw AND q.cl BETWEEN p.cl AND p.cl + 2", "q.rw BETWEEN p.rw - 1 AND p.rw AND q.cl BETWEEN p.cl AND p.cl + 1"),
    "vertical": ("q.cl = p.cl AND q.rw BETWEEN p.rw - 2 AND p.rw + 2", "q.rw BETWEEN p.rw - 1 AND p.rw + 1"),
    "horizontal": ("q.rw = p.rw AND q.cl BETWEEN p.cl - 2 AND p.cl + 2", "q.cl BETWEEN p.cl - 1 AND p.cl + 1"),
    "surrounding": ("q.rw BETWEEN p.rw - 2 AND p.rw + 2 AND q.cl BETWEEN p.cl - 2 AND p.cl + 2", "q.rw BETWEEN p.rw - 1 AND p.rw + 1 AND q.cl BETWEEN p.cl - 1 AND p.cl + 1"),
}
_NB_SELECT = ", ".join(f"CAST(coalesce((SELECT sum(q.total) FROM placed q WHERE q.c1 = p.c1 AND q.c2 = p.c2 AND {a} AND NOT ({b})), 0) AS BIGINT) AS n_{m}, (SELECT count(*) FROM grid q WHERE q.c1 = p.c1 AND q.c2 = p.c2 AND {a} AND NOT ({b})) AS area_{m}" for m, (a, b) in _SHAPES.items())


def _neighborhood(spark, sf_dir):
    return counts.Interactions(*_one_library(spark, sf_dir))


def _one_library(spark, sf_dir):
    p = demo.pairs(spark, sf_dir, near=True).withColumn("lib", F.lit("all"))
    data = counts.square_counts(p, demo.param(spark, sf_dir), ("all",), demo.WIDTH)
    return durable(data.pairs), durable(data.regions), data.libraries, data.totals, data.width


@query(f"{_NEAR}{_NB} SELECT a1, a2, total, {_NB_SELECT} FROM placed p")
def a7_enriched_pairs(spark, sf_dir):
    out = neighbors.enriched_pairs(_neighborhood(spark, sf_dir), 2, 1).pairs
    first = lambda c: F.get(c, F.lit(0)).alias("total" if c == "counts" else c)
    return out.select("a1", "a2", first("counts"), *[x for m in neighbors.MODES for x in (first(f"n_{m}"), f"area_{m}")])


_NB_LIBS = ", ".join(f"CAST(coalesce((SELECT sum(q.c_{x}) FROM placed q WHERE q.c1 = p.c1 AND q.c2 = p.c2 AND {a} AND NOT ({b})), 0) AS BIGINT) AS {m}_{x}" for m, (a, b) in _SHAPES.items() for x in LIBS)


@query(f"{_NEAR}{_NB} SELECT a1, a2, {_NB_LIBS} FROM placed p")
def a7_enriched_pairs_of_libraries(spark, sf_dir):
    out = neighbors.enriched_pairs(_square(spark, sf_dir, near=True), 2, 1).pairs
    return out.select("a1", "a2", *[F.get(f"n_{m}", F.lit(i)).cast("long").alias(f"{m}_{x}") for m in neighbors.MODES for i, x in enumerate(LIBS)])


@query(f"{_NEAR}{_NB} SELECT a1, a2, total, {_NB_SELECT} FROM placed p WHERE total >= 20")
def a6_neighbor_counts(spark, sf_dir):
    p = demo.pairs(spark, sf_dir, near=True).withColumn("lib", F.lit("all"))
    out = neighbors.neighbor_counts(p, demo.param(spark, sf_dir), ("all",), demo.WIDTH, 20, 2, 1).pairs
    first = lambda c: F.get(c, F.lit(0)).alias("total" if c == "counts" else c)
    return out.select("a1", "a2", first("counts"), *[x for m in neighbors.MODES for x in (first(f"n_{m}"), f"area_{m}")])


_AB = "log2(({y} + 2.0 * {s}) / ((SELECT sum(total) FROM cells) + 4.0) * 1e6) - log2({s})"
_BACK = "greatest(" + ", ".join(f"CASE WHEN area_{m} > 0 THEN {_AB.format(y=f'n_{m}', s=f'area_{m}')} ELSE -1e300 END" for m in _SHAPES) + ")"


@query(
    f"""{_NEAR}{_NB}, nb AS (SELECT p.*, {_NB_SELECT} FROM placed p), en AS (SELECT *, {_AB.format(y='total', s='1.0')} AS ab, {_AB.format(y='total', s='1.0')} - {_BACK} AS enr FROM nb)
    SELECT a1, a2, round(enr, 6) AS enrichment, enr > log2(1.5) AND ab > log2((5 + 2.0) / ((SELECT sum(total) FROM cells) + 4.0) * 1e6) AND (c1 <> c2 OR a1 - a2 >= 2) AS keep FROM en"""
)
def f10_filter_peaks(spark, sf_dir):
    data = neighbors.enriched_pairs(_neighborhood(spark, sf_dir), 2, 1)
    out = neighbors.filter_peaks(data, _totals(data))
    return out.select("a1", "a2", F.round("enrichment", 6).alias("enrichment"), "keep")


# ---- regions ----------------------------------------------------------------------------------------------

_REGIONS = ", rg AS (SELECT row_number() OVER (ORDER BY frag_id) AS original, chr, s + 200 AS rs, s + 2500 + 10 * (frag_id % 50) AS re FROM frag WHERE frag_id % 11 = 0)"


def _user_regions(spark, sf_dir):
    f = demo.fragments(spark, sf_dir).filter("frag_id % 11 = 0")
    return f.select((F.col("frag_id") / 11).cast("long").alias("original"), "chr", (F.col("start") + 200).alias("start"), (F.col("start") + 2500 + 10 * (F.col("frag_id") % 50)).alias("end"))


_STRETCH = """, st AS (SELECT original, chr_idx, coalesce(min(f.s), any_value(rs)) AS s, coalesce(max(f.e), any_value(re)) AS e, count(*) AS nf FROM rg JOIN frag f ON f.chr = rg.chr AND f.s <= re AND f.e >= rs GROUP BY original, chr_idx),
num AS (SELECT *, row_number() OVER (ORDER BY chr_idx, s, e, original) AS region_id FROM st),
tch AS (SELECT region_id, frag_id FROM num JOIN rg USING (original) JOIN frag f ON f.chr = rg.chr AND f.s <= re AND f.e >= rs)"""


@query(f"{_REGIONS}{_STRETCH}, pr AS (SELECT row_number() OVER () AS k, lib, id1, id2 FROM near), lk AS (SELECT DISTINCT k, lib, greatest(x.region_id, y.region_id) AS a1, least(x.region_id, y.region_id) AS a2 FROM pr JOIN tch x ON x.frag_id = id1 JOIN tch y ON y.frag_id = id2) SELECT a1, a2, {SLOTS} FROM lk GROUP BY 1, 2 HAVING count(*) >= 2")
def j1_connect_counts(spark, sf_dir):
    data = counts.connect_counts(demo.pairs(spark, sf_dir, near=True), demo.param(spark, sf_dir), durable(_user_regions(spark, sf_dir)), LIBS, least=2)
    return slots(data.pairs)


@query(f"{_REGIONS}{_STRETCH} SELECT region_id, original, CAST(s AS BIGINT) AS start, CAST(e AS BIGINT) AS \"end\", nf AS nfrags FROM num")
def j1a_stretched_regions(spark, sf_dir):
    data = counts.connect_counts(demo.pairs(spark, sf_dir), demo.param(spark, sf_dir), durable(_user_regions(spark, sf_dir)), LIBS)
    return data.regions.select("region_id", "original", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "nfrags")


@query(
    f"""{_REGIONS}, pr AS (SELECT row_number() OVER () AS k, * FROM near), num AS (SELECT *, row_number() OVER (ORDER BY chr, rs, re, original) AS region_id FROM rg),
    lk AS (SELECT DISTINCT k, lib, greatest(x.region_id, y.region_id) AS a1, least(x.region_id, y.region_id) AS a2 FROM pr JOIN num x ON x.chr = chr1 AND pos1 <= x.re AND pos1 + abs(len1) - 1 >= x.rs JOIN num y ON y.chr = chr2 AND pos2 <= y.re AND pos2 + abs(len2) - 1 >= y.rs) SELECT a1, a2, {SLOTS} FROM lk GROUP BY 1, 2"""
)
def j1_connect_counts_dnase(spark, sf_dir):
    param = PairParam(chromosomes=_lengths(spark, sf_dir))
    return slots(counts.connect_counts(demo.pairs(spark, sf_dir, near=True), param, durable(_user_regions(spark, sf_dir)), LIBS).pairs)


_TWO = ", r2 AS (SELECT row_number() OVER (ORDER BY frag_id) AS original, chr, s - 300 AS rs, s + 1800 AS re FROM frag WHERE frag_id % 17 = 0)"
_ONE_IN_EACH = "SELECT DISTINCT k, lib, greatest(x.region_id, y.region_id) AS a1, least(x.region_id, y.region_id) AS a2 FROM pr JOIN tch x ON x.frag_id = id1 JOIN tch y ON y.frag_id = id2 WHERE x.st <> y.st"


@query(
    f"""{_REGIONS}{_TWO}, al AS (SELECT 1 AS st, * FROM rg UNION ALL SELECT 2, * FROM r2), st AS (SELECT al.st, original, chr_idx, min(f.s) AS s, max(f.e) AS e FROM al JOIN frag f ON f.chr = al.chr AND f.s <= re AND f.e >= rs GROUP BY ALL),
    num AS (SELECT *, row_number() OVER (ORDER BY chr_idx, s, e, st, original) AS region_id FROM st), tch AS (SELECT num.st, region_id, frag_id FROM num JOIN al USING (st, original) JOIN frag f ON f.chr = al.chr AND f.s <= re AND f.e >= rs),
    pr AS (SELECT row_number() OVER () AS k, lib, id1, id2 FROM near), lk AS ({_ONE_IN_EACH}) SELECT a1, a2, {SLOTS} FROM lk GROUP BY 1, 2"""
)
def j1_connect_two_sets(spark, sf_dir):
    other = demo.fragments(spark, sf_dir).filter("frag_id % 17 = 0").select((F.col("frag_id") / 17).cast("long").alias("original"), "chr", (F.col("start") - 300).alias("start"), (F.col("start") + 1800).alias("end"))
    return slots(counts.connect_counts(demo.pairs(spark, sf_dir, near=True), demo.param(spark, sf_dir), durable(_user_regions(spark, sf_dir)), LIBS, second=durable(other)).pairs)


_RESTRICTED = """, al AS (SELECT * FROM rg WHERE chr IN ('chr2', 'chr3')), bn AS (SELECT * FROM reg WHERE chr IN ('chr2', 'chr3')), st AS (SELECT 1 AS st, original AS key, original, chr_idx, min(f.s) AS s, max(f.e) AS e, count(*) AS nf FROM al JOIN frag f ON f.chr = al.chr AND f.s <= re AND f.e >= rs GROUP BY original, chr_idx UNION ALL SELECT 2, region_id, NULL, chr_idx, s, e, nfrags FROM bn),
    num AS (SELECT *, row_number() OVER (ORDER BY chr_idx, s, e, st, key) AS region_id FROM st)"""


@query(
    f"""{_REGIONS}{_RESTRICTED}, tch AS (SELECT st, region_id, frag_id FROM num JOIN al ON st = 1 AND al.original = key JOIN frag f ON f.chr = al.chr AND f.s <= re AND f.e >= rs UNION ALL SELECT 2, num.region_id, frag_id FROM num JOIN bin ON st = 2 AND bin.bin = key),
    pr AS (SELECT row_number() OVER () AS k, lib, id1, id2 FROM near WHERE chr1 IN ('chr2', 'chr3') AND chr2 IN ('chr2', 'chr3')), lk AS ({_ONE_IN_EACH}) SELECT a1, a2, {SLOTS} FROM lk GROUP BY 1, 2"""
)
def j1_connect_to_bins(spark, sf_dir):
    """Regions against the genome's bins, on two chromosomes."""
    param = demo.param(spark, sf_dir, restrict=("chr2", "chr3"))
    return slots(counts.connect_counts(demo.pairs(spark, sf_dir, near=True), param, durable(_user_regions(spark, sf_dir)), LIBS, second=demo.WIDTH, restrict_regions=True).pairs)


@query(f"{_REGIONS}{_RESTRICTED} SELECT region_id, original, CAST(s AS BIGINT) AS start, CAST(e AS BIGINT) AS \"end\", nf AS nfrags FROM num")
def j1c_restricted_regions(spark, sf_dir):
    param = demo.param(spark, sf_dir, restrict=("chr2", "chr3"))
    data = counts.connect_counts(demo.pairs(spark, sf_dir, near=True), param, durable(_user_regions(spark, sf_dir)), LIBS, second=demo.WIDTH, restrict_regions=True)
    return data.regions.select("region_id", "original", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "nfrags")


_FEATURES = ", ft AS (SELECT chr, s, e, 'g' || (frag_id % 97) AS name FROM frag WHERE frag_id % 3 = 0)"


def _features(spark, sf_dir):
    return demo.fragments(spark, sf_dir).filter("frag_id % 3 = 0").select("chr", "start", "end", F.concat(F.lit("g"), (F.col("frag_id") % 97).cast("string")).alias("name"))


@query(
    f"""{_CELLS}{_ENDS}{_FEATURES}, bx AS (SELECT (a1 * 7 + a2) % 41 AS key, * FROM ends WHERE total >= 6), nm AS (SELECT DISTINCT key, i, name FROM (SELECT key, 1 AS i, chr1 AS c, s1 AS s, e1 AS e FROM bx UNION ALL SELECT key, 2, chr2, s2, e2 FROM bx) b JOIN ft ON ft.chr = b.c AND ft.s <= b.e AND ft.e >= b.s)
    SELECT key, {', '.join(f"coalesce((SELECT string_agg(name, ',' ORDER BY name) FROM nm WHERE nm.key = k.key AND i = {i}), '') AS names{i}" for i in (1, 2))} FROM (SELECT DISTINCT key FROM bx) k"""
)
def j6_annotate_pairs(spark, sf_dir):
    ends = filters.with_ends(_square(spark, sf_dir, least=6)).withColumn("key", (F.col("a1") * 7 + F.col("a2")) % 41)
    return results.annotate_pairs(durable(ends), _features(spark, sf_dir), "key")


@query(
    f"""{_REGIONS}, ft AS (SELECT chr, s, e, 'g' || (frag_id % 97) AS name FROM frag WHERE frag_id % 3 = 0)
    SELECT original, coalesce((SELECT string_agg(name, ',' ORDER BY name) FROM (SELECT DISTINCT name FROM ft WHERE ft.chr = rg.chr AND ft.s <= re AND ft.e >= rs)), '') AS names FROM rg"""
)
def j6_annotate(spark, sf_dir):
    features = demo.fragments(spark, sf_dir).filter("frag_id % 3 = 0").select("chr", "start", "end", F.concat(F.lit("g"), (F.col("frag_id") % 97).cast("string")).alias("name"))
    return results.annotate_regions(_user_regions(spark, sf_dir), features, "original")


_J3 = ", rd AS (SELECT chr1 AS chr, CASE WHEN len1 < 0 THEN pos1 - len1 - 1 ELSE pos1 END AS five, len1 < 0 AS rev FROM pairs UNION ALL SELECT chr2, CASE WHEN len2 < 0 THEN pos2 - len2 - 1 ELSE pos2 END, len2 < 0 FROM pairs), fw AS (SELECT rd.chr, rev, five, frag_id FROM rd ASOF JOIN frag f ON rd.chr = f.chr AND five >= f.s WHERE NOT rev), rv AS (SELECT rd.chr, rev, five, frag_id FROM rd ASOF JOIN frag f ON rd.chr = f.chr AND five <= f.e WHERE rev)"


@query(f"{_J3} SELECT chr, rev, frag_id, count(*) AS n FROM (FROM fw UNION ALL FROM rv) GROUP BY ALL")
def j3_assign_fragments(spark, sf_dir):
    p = demo.pairs(spark, sf_dir)
    ends = [F.struct(F.col(f"chr{i}").alias("chr"), five_prime(F.col(f"anchor{i}_pos"), F.col(f"anchor{i}_len")).alias("five"), (F.col(f"anchor{i}_len") < 0).alias("reverse")) for i in (1, 2)]
    reads = p.select(F.explode(F.array(*ends)).alias("x")).select("x.*")
    out = alignments.assign_fragments(reads, demo.fragments(spark, sf_dir))
    return out.groupBy("chr", F.col("reverse").alias("rev"), "frag_id").agg(F.count(F.lit(1)).alias("n"))


# ---- filters ----------------------------------------------------------------------------------------------


@query(f"{_CELLS}{_ENDS} SELECT a1, a2, CASE WHEN chr1 = chr2 THEN abs((s1 + e1) / 2.0 - (s2 + e2) / 2.0) END AS mid, CASE WHEN chr1 = chr2 THEN CAST(a1 - a2 AS DOUBLE) END AS diag, CASE WHEN chr1 = chr2 THEN CAST(greatest(s1, s2) - least(e1, e2) - 1 AS DOUBLE) END AS gap FROM ends")
def f13_distance(spark, sf_dir):
    ends = filters.with_ends(_square(spark, sf_dir))
    return ends.select("a1", "a2", *[filters.distance(k).alias(k) for k in ("mid", "diag", "gap")])


@query(f"{_CELLS}{_ENDS} SELECT a1, a2, (e1 - s1 + 1.0) * (e2 - s2 + 1) - CASE WHEN chr1 = chr2 AND least(e1, e2) >= greatest(s1, s2) THEN (least(e1, e2) - greatest(s1, s2) + 1.0) * (least(e1, e2) - greatest(s1, s2)) / 2 ELSE 0 END AS bp, CASE WHEN a1 = a2 THEN nf1 * (nf1 + 1) / 2.0 ELSE CAST(nf1 * nf2 AS DOUBLE) END AS frags FROM ends")
def f12_area(spark, sf_dir):
    ends = filters.with_ends(_square(spark, sf_dir))
    return ends.select("a1", "a2", filters.area().alias("bp"), filters.area(bp=False).alias("frags"))


@query(f"{_CELLS}{_ENDS} SELECT a1, a2, chr1 <> chr2 OR (abs((s1 + e1) / 2.0 - (s2 + e2) / 2.0) > 60000 AND a1 - a2 > 1) AS keep FROM ends")
def f9_filter_diagonal(spark, sf_dir):
    ends = filters.with_ends(_square(spark, sf_dir))
    return ends.select("a1", "a2", filters.filter_diagonal(60000, 1).alias("keep"))


@query(f"{_NEAR} SELECT a1, a2, round(log2((total + 2.0) / ((SELECT sum(total) FROM cells) + 4.0) * 1e6), 6) AS abundance FROM cells")
def f15_abundance(spark, sf_dir):
    data = _neighborhood(spark, sf_dir)
    return data.pairs.select("a1", "a2", F.round(abundance(F.col("counts"), _totals(data)), 6).alias("abundance"))


def _newton_sql(prior: float, steps: int = 12) -> str:
    """The negative-binomial mean of three libraries by Newton steps, one subquery a step."""
    sizes = "SELECT " + ", ".join(f"(SELECT count(*) FROM near WHERE lib = '{x}')::DOUBLE AS t_{x}" for x in LIBS)
    mean = "((" + " + ".join(f"t_{x}" for x in LIBS) + ") / 3)"
    base = "SELECT a1, a2, " + ", ".join(f"c_{x} + {prior} * t_{x} / {mean} AS y_{x}, t_{x} + 2 * {prior} * t_{x} / {mean} AS s_{x}" for x in LIBS) + f" FROM cells, ({sizes}) z"
    out = "SELECT *, ln((" + " + ".join(f"y_{x}" for x in LIBS) + ") / (" + " + ".join(f"s_{x}" for x in LIBS) + f")) AS b FROM ({base}) q"
    for _ in range(steps):
        up = " + ".join(f"(y_{x} - s_{x} * exp(b)) / (1 + 0.05 * s_{x} * exp(b))" for x in LIBS)
        down = " + ".join(f"s_{x} * exp(b) / (1 + 0.05 * s_{x} * exp(b))" for x in LIBS)
        out = f"SELECT * REPLACE (b + ({up}) / ({down}) AS b) FROM ({out}) q"
    return out


@query(f"{_NEAR}, nw AS ({_newton_sql(2.0)}) SELECT a1, a2, round((b + ln(1e6)) / ln(2), 6) AS abundance FROM nw")
def f15_abundance_of_libraries(spark, sf_dir):
    data = _square(spark, sf_dir, near=True)
    return data.pairs.select("a1", "a2", F.round(abundance(F.col("counts"), _totals(data)), 6).alias("abundance"))


@query(f"{_NEAR}, z AS (SELECT " + ", ".join(f"(SELECT count(*) FROM near WHERE lib = '{x}')::DOUBLE AS t_{x}" for x in LIBS) + ") SELECT a1, a2, round(total / ((" + " + ".join(f"t_{x}" for x in LIBS) + ") / ((" + " + ".join(f"t_{x}" for x in LIBS) + ") / 3)), 9) AS mean FROM cells, z")
def a13_mean_of_libraries(spark, sf_dir):
    data = _square(spark, sf_dir, near=True)
    return normalize.mean_counts(data, _totals(data)).select("a1", "a2", F.round("mean", 9).alias("mean"))


@query(f"{_CELLS}{_ENDS}, sc AS (SELECT *, log2((total + 2.0) / ((SELECT sum(total) FROM cells) + 4.0) * 1e6) AS ab FROM ends), z AS (SELECT chr_idx, count(*) AS k FROM reg GROUP BY 1), pos AS (SELECT greatest(1, sum(k) * (sum(k) + 1) / 2 - sum(k * (k + 1) / 2)) AS p FROM z), sh AS (SELECT count(*) / (SELECT p FROM pos) AS q FROM sc WHERE chr1 <> chr2), v AS (SELECT list_sort(list(ab)) AS l, CASE WHEN (SELECT q FROM sh) >= 1 THEN 0.5 ELSE 1 - 0.5 / (SELECT q FROM sh) END AS q FROM sc WHERE chr1 <> chr2), h AS (SELECT l, (len(l) - 1) * q AS h FROM v) SELECT round(CASE WHEN (SELECT q FROM sh) < 0.5 THEN log2(2.0 / ((SELECT sum(total) FROM cells) + 4.0) * 1e6) ELSE (SELECT l[CAST(floor(h) AS INT) + 1] + (h - floor(h)) * (l[CAST(ceil(h) AS INT) + 1] - l[CAST(floor(h) AS INT) + 1]) FROM h) END, 6) AS threshold")
def f7_filter_direct(spark, sf_dir):
    p = demo.pairs(spark, sf_dir).withColumn("lib", F.lit("all"))
    data = counts.square_counts(p, demo.param(spark, sf_dir), ("all",), demo.WIDTH)
    threshold = filters.filter_direct(data, _totals(data))[1]
    return spark.range(1).select(F.round(F.lit(threshold), 6).alias("threshold"))


@query()
def f8_filter_trended(spark, sf_dir):
    data = _neighborhood(spark, sf_dir)
    return filters.trended(data, _totals(data)).select("a1", "a2", "abundance", "log_distance", "trend")


# ---- results ----------------------------------------------------------------------------------------------

_TESTS = ", t AS (SELECT a1 * 100000 + a2 AS box_id, chr1, s1, e1, chr2, s2, e2, a1 % 2 AS set_id, ((a1 * 7919 + a2 * 104729) % 10007 + 1) / 10008.0 AS p FROM ends)"


def _tests(spark, sf_dir):
    e = filters.with_ends(_square(spark, sf_dir))
    p = (F.pmod(F.col("a1") * 7919 + F.col("a2") * 104729, F.lit(10007)) + 1) / 10008.0
    return durable(e.select((F.col("a1") * 100000 + F.col("a2")).alias("box_id"), "a1", "a2", "chr1", "start1", "end1", "chr2", "start2", "end2", (F.col("a1") % 2).alias("set_id"), p.alias("p_value")))


@query(f"{_CELLS}{_ENDS}{_TESTS}, w AS (SELECT *, 1.0 / count(*) OVER (PARTITION BY set_id) AS w FROM t), u AS (SELECT p, sum(w) AS w FROM w GROUP BY p), c AS (SELECT p, (SELECT sum(w) FROM u) * p / sum(w) OVER (ORDER BY p ROWS UNBOUNDED PRECEDING) AS raw FROM u), a AS (SELECT p, least(1, min(raw) OVER (ORDER BY p DESC ROWS UNBOUNDED PRECEDING)) AS adj FROM c) SELECT box_id, round(adj, 6) AS adjusted FROM t JOIN a USING (p)")
def a11_weighted_fdr(spark, sf_dir):
    weighed = _tests(spark, sf_dir).withColumn("weight", 1 / F.count(F.lit(1)).over(Window.partitionBy("set_id")))
    return results.weighted_fdr(weighed).select("box_id", F.round("adjusted", 6).alias("adjusted"))


@query(f"{_CELLS}{_ENDS}{_TESTS}, k AS (SELECT *, box_id % 23 AS cl FROM t), w AS (SELECT *, 1.0 / count(*) OVER (PARTITION BY set_id, cl) AS w FROM k), s AS (SELECT cl, p * sum(w) OVER (PARTITION BY cl) / sum(w) OVER (PARTITION BY cl ORDER BY p) AS v FROM w) SELECT CAST(cl AS BIGINT) AS cluster_id, count(*) AS n, round(least(1, min(v)), 6) AS p_value FROM s GROUP BY cl")
def a10_consolidate(spark, sf_dir):
    out = results.consolidate(_tests(spark, sf_dir).withColumn("cluster_id", F.col("box_id") % 23))
    return out.select("cluster_id", "n", F.round("p_value", 6).alias("p_value"))


@query(f"{_CELLS}{_ENDS}{_TESTS}, par AS (SELECT row_number() OVER (ORDER BY chr, i) AS pid, chr, i * 200000 + 1 AS ps, (i + 1) * 200000 + 60000 AS pe FROM (SELECT DISTINCT chr FROM reg), range(8) r(i)), b AS (SELECT t.*, (SELECT min(pid) FROM par WHERE chr = chr1 AND s1 >= ps AND e1 <= pe) AS q1, (SELECT min(pid) FROM par WHERE chr = chr2 AND s2 >= ps AND e2 <= pe) AS q2 FROM t), x AS (SELECT *, greatest(q1, q2) AS p1, least(q1, q2) AS p2 FROM b) SELECT box_id, CASE WHEN q1 IS NOT NULL AND q2 IS NOT NULL THEN p1 END AS p1, CASE WHEN q1 IS NOT NULL AND q2 IS NOT NULL THEN p2 END AS p2, CASE WHEN q1 IS NOT NULL AND q2 IS NOT NULL THEN min(s1) OVER (PARTITION BY p1, p2, q1 IS NULL OR q2 IS NULL) END AS min_start1 FROM x")
def j7_nest_boxes(spark, sf_dir):
    names = counts.bin_regions(counts.fragment_bins(demo.fragments(spark, sf_dir), demo.WIDTH)).select("chr").distinct()
    parents = names.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(7)))).withColumn("region_id", F.row_number().over(Window.orderBy("chr", "i")).cast("long"))
    parents = parents.select("region_id", "chr", (F.col("i") * 200000 + 1).alias("start"), ((F.col("i") + 1) * 200000 + 60000).alias("end"))
    out = results.nest_boxes(_tests(spark, sf_dir), parents, smallest=True)
    inside = F.col("box_index").isNotNull()
    return out.select("box_id", F.when(inside, F.col("p1")).alias("p1"), F.when(inside, F.col("p2")).alias("p2"), "min_start1")


def _binned_sql(name: str, width: int) -> str:
    return f", {name} AS (SELECT frag_id, dense_rank() OVER (ORDER BY chr_idx, floor(((s + e) / 2.0 - 0.1) / {width})) AS bin FROM frag)"


_SETS = " UNION ALL ".join(f"SELECT DISTINCT {k} AS set_id, a.bin AS a1, b.bin AS a2, u.bin AS p1, v.bin AS p2 FROM near p JOIN b{k} a ON a.frag_id = id1 JOIN b{k} b ON b.frag_id = id2 JOIN bp u ON u.frag_id = id1 JOIN bp v ON v.frag_id = id2" for k in (0, 1))


@query(f"{_binned_sql('b0', 25000)}{_binned_sql('b1', 50000)}{_binned_sql('bp', 100000)}, al AS ({_SETS}) SELECT set_id, a1, a2, dense_rank() OVER (ORDER BY p1, p2) AS box_index FROM al")
def j7_box_pairs(spark, sf_dir):
    """Bin pairs of two sizes in bins of a third."""
    p, param = demo.pairs(spark, sf_dir, near=True), demo.param(spark, sf_dir)
    sets = [counts.square_counts(p, param, LIBS, w) for w in (25_000, 50_000)]
    indices = results.box_pairs(sets, param, reference=100_000, index_only=True)[0]
    return indices[0].withColumn("set_id", F.lit(0)).unionByName(indices[1].withColumn("set_id", F.lit(1))).select("set_id", "a1", "a2", F.col("box_index").cast("long").alias("box_index"))


_LINK = "x.chr1 = y.chr1 AND x.chr2 = y.chr2 AND y.s1 - x.e1 - 1 < 1 AND x.s1 - y.e1 - 1 < 1 AND y.s2 - x.e2 - 1 < 1 AND x.s2 - y.e2 - 1 < 1"


@query(f"{_CELLS}{_ENDS}{_TESTS}, v AS (SELECT * FROM t WHERE p < 0.2), e AS (SELECT x.box_id AS a, y.box_id AS b FROM v x JOIN v y ON {_LINK}), cc AS (WITH RECURSIVE r AS (SELECT box_id, box_id AS root FROM v UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.box_id) SELECT box_id, min(root) AS root FROM r GROUP BY 1) SELECT box_id, dense_rank() OVER (ORDER BY root) AS cluster_id FROM cc")
def c1_cluster_pairs(spark, sf_dir):
    out = results.cluster_boxes(_tests(spark, sf_dir).filter("p_value < 0.2"), tol=1, upper=None)
    return out.select("box_id", F.col("cluster_id").cast("long").alias("cluster_id"))


@query(f"{_CELLS}{_ENDS}{_TESTS}, v AS (SELECT * FROM t WHERE p < 0.2), e AS (SELECT x.box_id AS a, y.box_id AS b FROM v x JOIN v y ON {_LINK}), cc AS (WITH RECURSIVE r AS (SELECT box_id, box_id AS root FROM v UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.box_id) SELECT box_id, min(root) AS root FROM r GROUP BY 1) SELECT dense_rank() OVER (ORDER BY root) AS cluster_id, min(chr1) AS chr1, min(chr2) AS chr2, min(s1) AS min_start1, max(e1) AS max_end1, min(s2) AS min_start2, max(e2) AS max_end2 FROM cc JOIN v USING (box_id) GROUP BY root")
def a8_bounding_boxes(spark, sf_dir):
    out = results.cluster_boxes(_tests(spark, sf_dir).filter("p_value < 0.2"), tol=1, upper=None)
    return results.bounding_boxes(out).withColumn("cluster_id", F.col("cluster_id").cast("long"))


_COMPONENTS = f"e AS (SELECT x.box_id AS a, y.box_id AS b FROM v x JOIN v y ON {_LINK}), cc AS (WITH RECURSIVE r AS (SELECT box_id, box_id AS root FROM v UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.box_id) SELECT box_id, min(root) AS root FROM r GROUP BY 1)"
_CUT = "floor(((s{i} + e{i} + 1) / 2.0 - l{i}) / (n{i} / p{i}))"


@query(
    f"""{_CELLS}{_ENDS}{_TESTS}, v AS (SELECT * FROM t WHERE p < 0.3), {_COMPONENTS}, o AS (SELECT cc.root, v.*, min(s1) OVER w AS l1, max(e1 + 1) OVER w - min(s1) OVER w AS n1, min(s2) OVER w AS l2, max(e2 + 1) OVER w - min(s2) OVER w AS n2 FROM cc JOIN v USING (box_id) WINDOW w AS (PARTITION BY root)),
    q AS (SELECT *, CASE WHEN n1 > 150000 THEN floor(n1 / 150000.0 + 0.5) ELSE 1.0 END AS p1, CASE WHEN n2 > 150000 THEN floor(n2 / 150000.0 + 0.5) ELSE 1.0 END AS p2 FROM o), g AS (SELECT box_id, root, {_CUT.format(i=1)} * p2 + {_CUT.format(i=2)} AS cell FROM q)
    SELECT box_id, dense_rank() OVER (ORDER BY lead) AS cluster_id FROM (SELECT box_id, min(box_id) OVER (PARTITION BY root, cell) AS lead FROM g)"""
)
def c1a_split_clusters(spark, sf_dir):
    return results.cluster_boxes(_tests(spark, sf_dir).filter("p_value < 0.3"), tol=1, upper=150000).select("box_id", F.col("cluster_id").cast("long").alias("cluster_id"))


@query()
def c2_significant_clusters(spark, sf_dir):
    return results.significant_clusters(_tests(spark, sf_dir), target=0.3)[0].select("box_id", "cluster_id")


# ---- normalisation ----------------------------------------------------------------------------------------


def _round_sql(k: int) -> str:
    return f""", c{k} AS (SELECT bin, sqrt(sum(v)) AS c FROM (SELECT a1 AS bin, w / (x.b * y.b) AS v FROM w0 JOIN b{k - 1} x ON x.bin = a1 JOIN b{k - 1} y ON y.bin = a2 UNION ALL SELECT a2, w / (x.b * y.b) FROM w0 JOIN b{k - 1} x ON x.bin = a1 JOIN b{k - 1} y ON y.bin = a2) GROUP BY bin),
    b{k} AS (SELECT bin, b * c AS b FROM b{k - 1} JOIN c{k} USING (bin))"""


@query(f"{_NEAR}{_ENDS}, w0 AS (SELECT a1, a2, CAST(total AS DOUBLE) AS w FROM ends WHERE NOT (chr1 = chr2 AND a1 - a2 <= 1)), b0 AS (SELECT DISTINCT bin, 1.0::DOUBLE AS b FROM (SELECT a1 AS bin FROM w0 UNION ALL SELECT a2 FROM w0)){_round_sql(1)}{_round_sql(2)} SELECT ends.a1, ends.a2, round(total / (x.b * y.b), 5) AS truth FROM ends JOIN b2 x ON x.bin = a1 JOIN b2 y ON y.bin = a2")
def n1_corrected_contacts(spark, sf_dir):
    data = _neighborhood(spark, sf_dir)
    out = normalize.corrected_contacts(normalize.mean_counts(data, _totals(data)), data.regions, iterations=2, ignore_low=0, winsor_high=0)[0]
    return out.filter("truth is not null").select("a1", "a2", F.round("truth", 5).alias("truth"))


def _correction_sql(weights: str, low: float = 0.02, high: float = 0.02, rounds: int = 50) -> str:
    """Whole correction of (a1, a2, w, local): winsorised, bins of least coverage dropped, then the rounds."""
    out = f""", all0 AS MATERIALIZED ({weights}), u0 AS MATERIALIZED (SELECT a1, a2, w FROM all0 WHERE NOT local),
    u1 AS MATERIALIZED (SELECT a1, a2, CASE WHEN k > 0 THEN least(w, top) ELSE w END AS w FROM u0, (SELECT floor(count(*) * {high}) AS k FROM u0), (SELECT min(w) AS top FROM (SELECT w, row_number() OVER (ORDER BY w DESC) AS r FROM u0) WHERE r <= (SELECT floor(count(*) * {high}) + 1 FROM u0))),
    cv AS MATERIALIZED (SELECT bin, row_number() OVER (ORDER BY sum(w), bin) AS r FROM (SELECT a1 AS bin, w FROM u1 UNION ALL SELECT a2, w FROM u1) GROUP BY bin),
    lo AS MATERIALIZED (SELECT bin FROM cv WHERE r <= (SELECT floor(count(*) * {low}) FROM cv)),
    w0 AS MATERIALIZED (SELECT * FROM u1 WHERE a1 NOT IN (FROM lo) AND a2 NOT IN (FROM lo)),
    b0 AS MATERIALIZED (SELECT DISTINCT bin, 1.0::DOUBLE AS b FROM (SELECT a1 AS bin FROM w0 UNION ALL SELECT a2 FROM w0))"""
    for k in range(1, rounds + 1):
        out += _round_sql(k).replace(f"c{k} AS (", f"c{k} AS MATERIALIZED (").replace(f"b{k} AS (", f"b{k} AS MATERIALIZED (")
    return out


@query(f"{_NEAR}{_ENDS}{_correction_sql('SELECT a1, a2, CAST(total AS DOUBLE) AS w, chr1 = chr2 AND a1 - a2 <= 1 AS local FROM ends')} SELECT a.a1, a.a2, a.w AS mean, round(a.w / (x.b * y.b), 5) AS truth FROM all0 a LEFT JOIN b50 x ON x.bin = a.a1 LEFT JOIN b50 y ON y.bin = a.a2")
def n1_corrected_contacts_full(spark, sf_dir):
    """With the operator's own options."""
    data = _neighborhood(spark, sf_dir)
    out = normalize.corrected_contacts(normalize.mean_counts(data, _totals(data)), data.regions)[0]
    return out.select("a1", "a2", "mean", F.round("truth", 5).alias("truth"))


_LIBRARY_TRUTH = " UNION ALL ".join(
    f"(WITH ends AS (FROM ends){_correction_sql(f'SELECT a1, a2, CAST(c_{x} AS DOUBLE) AS w, chr1 = chr2 AND a1 - a2 <= 1 AS local FROM ends WHERE c_{x} > 0', rounds=8)} SELECT '{x}' AS lib, a.a1, a.a2, round(a.w / (x.b * y.b), 5) AS truth FROM all0 a LEFT JOIN b8 x ON x.bin = a.a1 LEFT JOIN b8 y ON y.bin = a.a2)"
    for x in LIBS
)


@query(f"{_NEAR}{_ENDS} FROM ({_LIBRARY_TRUTH})")
def n1_corrected_by_library(spark, sf_dir):
    """Every library by itself; eight rounds."""
    data = _square(spark, sf_dir, near=True)
    data = data.with_pairs(durable(data.pairs))
    out = normalize.corrected_interactions(data, _totals(data), average=False, iterations=8)[0]
    return out.select("lib", "a1", "a2", F.round("truth", 5).alias("truth"))


@query()
def n1_corrected_for_distance(spark, sf_dir):
    data = _neighborhood(spark, sf_dir)
    return normalize.corrected_interactions(data, _totals(data), dist_correct=True)[0]


@query()
def n2_copy_number_offsets(spark, sf_dir):
    data = _square(spark, sf_dir, least=5)
    data = data.with_pairs(durable(data.pairs))
    margins = durable(counts.margin_counts(demo.pairs(spark, sf_dir), demo.param(spark, sf_dir), LIBS, demo.WIDTH))
    return slots_double(normalize.copy_number_offsets(data, margins, _totals(data)))


def slots_double(df):
    return df.select("a1", "a2", *[F.get("offsets", F.lit(i)).alias(f"o_{x}") for i, x in enumerate(LIBS)])


@query()
def n3_compartments(spark, sf_dir):
    data = _neighborhood(spark, sf_dir)
    return normalize.compartments(data, _totals(data))


# ---- sources and geometry ---------------------------------------------------------------------------------


@query("SELECT n_nationkey AS chr_idx, 'n' || n_nationkey AS chr, length(n_name) * 4 AS length FROM nation", with_demo=False)
def s12_empty_genome(spark, sf_dir):
    return genome.empty_genome(_genome(spark, sf_dir, 4))


def _genome(spark, sf_dir, times):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return n.select(F.col("n_nationkey").alias("chr_idx"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("chr"), F.translate(F.repeat(F.upper("n_name"), times), "BDEFHIJKLMNOPQRSUVWXYZ ", "ACGTACGTACGTACGTACGTACG").alias("seq"))


_GEN = "g AS (SELECT n_nationkey AS chr_idx, 'n' || n_nationkey AS chr, translate(repeat(upper(n_name), 20), 'BDEFHIJKLMNOPQRSUVWXYZ ', 'ACGTACGTACGTACGTACGTACG') AS seq FROM nation)"


@query(f"WITH {_GEN}, h AS (SELECT chr, chr_idx, length(seq) AS size, i AS m FROM g, LATERAL (SELECT unnest(range(1, length(seq))) AS i) x WHERE substr(seq, i, 2) = 'CG'), f AS (SELECT chr, chr_idx, coalesce(lag(m) OVER (PARTITION BY chr ORDER BY m), 1) AS start, m + 1 AS e FROM h UNION ALL SELECT chr, chr_idx, coalesce((SELECT max(m) FROM h WHERE h.chr = g.chr), 1), length(seq) FROM g) SELECT row_number() OVER (ORDER BY chr_idx, start, e) AS frag_id, chr, chr_idx, start, e AS \"end\" FROM f", with_demo=False)
def s11_cut_genome(spark, sf_dir):
    return genome.cut_genome(_genome(spark, sf_dir, 20), ["CG"], 2, piece=64)


@query(f"{_CELLS}, m AS (SELECT a1, a2, c_A * 0.5 AS x0, c_N * 0.25 AS x1, c_R * 1.0 AS x2 FROM cells) SELECT a1, a2, x0::DOUBLE AS x0, x1::DOUBLE AS x1, x2::DOUBLE AS x2 FROM m WHERE x0 + x1 + x2 >= 3")
def s10_merge_matrices(spark, sf_dir):
    data = _square(spark, sf_dir)
    parts = [data.pairs.select(F.col(r).alias("row"), F.col(c).alias("col"), (F.get("counts", F.lit(i)) * x).alias("value")) for i, (r, c, x) in enumerate((("a1", "a2", 0.5), ("a2", "a1", 0.25), ("a1", "a2", 1.0)))]
    out = matrices.merge_matrices(parts, data.regions, 3).pairs
    return out.select("a1", "a2", *[F.get("counts", F.lit(i)).alias(f"x{i}") for i in range(3)])


@query(f"{_CELLS} SELECT a1, a2, {', '.join('c_' + x for x in LIBS)} FROM cells")
def s9_read_matrices(spark, sf_dir):
    """The counts written as one MTX file per library, with a comment, a header and entries on either side of the diagonal, and read back."""
    data = _square(spark, sf_dir)
    pairs, regions = durable(data.pairs), durable(data.regions)
    n, bed = regions.count(), scratch_path(spark, "bed")
    line = F.concat_ws("\t", "chr", (F.col("start") - 1).cast("string"), F.col("end").cast("string"))
    regions.coalesce(1).sortWithinPartitions("region_id").select(line.alias("value")).write.text(bed)
    paths = []
    for i in range(len(LIBS)):
        paths.append(scratch_path(spark, "mtx"))
        part = pairs.select("a1", "a2", F.get("counts", F.lit(i)).alias("v")).filter("v > 0")
        turn = (F.col("a1") + F.col("a2")) % 2 == 0
        body = part.select(F.lit(2).alias("k"), F.concat_ws(" ", *[F.when(turn, F.col(x)).otherwise(F.col(y)).cast("string") for x, y in (("a1", "a2"), ("a2", "a1"))], F.col("v").cast("string")).alias("value"))
        head = spark.createDataFrame([(0, "%%MatrixMarket matrix coordinate integer general"), (1, f"{n} {n} {part.count()}")], "k int, value string")
        head.union(body).coalesce(1).sortWithinPartitions("k").select("value").write.text(paths[-1])
    return slots(matrices.read_mtx(spark, paths, bed).pairs)


@query("SELECT CAST(p_partkey AS BIGINT) AS id, CAST(p_size + 12 + p_partkey % 7 AS BIGINT) AS width, CAST(p_partkey % 5 AS BIGINT) AS clip, CAST(CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 4 + 1 ELSE 0 END AS BIGINT) AS clip_reverse FROM part", with_demo=False)
def s1a_cigar(spark, sf_dir):
    """Widths and 5' clips of made CIGAR strings; inserted and soft-clipped bases do not count."""
    key = F.col("p_partkey")

    def op(n, letter):
        return F.concat(n.cast("string"), F.lit(letter))

    tail = F.when(key % 3 == 0, op(key % 4 + 1, "H")).otherwise(op(key % 4 + 1, "S"))
    cigar = F.concat(F.when(key % 5 > 0, op(key % 5, "H")).otherwise(""), F.lit("2S"), op(F.col("p_size"), "M"), F.lit("3I10D1N1="), op(key % 7, "X"), tail)
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", cigar.alias("cigar"))
    clips = [clip_offset(F.col("cigar"), F.lit(x)).cast("long") for x in (False, True)]
    return part.select(F.col("p_partkey").cast("long").alias("id"), reference_width(F.col("cigar")).cast("long").alias("width"), clips[0].alias("clip"), clips[1].alias("clip_reverse"))


@query(" SELECT lib, chr1, chr2, count(*) AS n_pairs, CAST(0 AS BIGINT) AS out_of_order FROM pairs GROUP BY ALL")
def s3_stored_order(spark, sf_dir):
    return store.check_order(spark, _stored(spark, sf_dir))


_COLOUR = "printf('#%02X%02X%02X', v, v, v)"


@query(f"{_CELLS}{_ENDS}, pt AS (SELECT *, CAST(round(255 - 255 * least(1.0, total / 20.0)) AS INT) AS v FROM ends WHERE chr1 = 'chr2' AND chr2 = 'chr1' AND s1 <= 500000 AND e1 >= 1 AND s2 <= 400000 AND e2 >= 1) SELECT CAST(s1 - 0.5 AS DOUBLE) AS x0, CAST(e1 + 0.5 AS DOUBLE) AS x1, CAST(s2 - 0.5 AS DOUBLE) AS y0, CAST(e2 + 0.5 AS DOUBLE) AS y1, total AS count, {_COLOUR} AS colour FROM pt")
def v1_plaid(spark, sf_dir):
    out = geometry.plaid(demo.pairs(spark, sf_dir), demo.param(spark, sf_dir), ("chr2", 1, 500000), ("chr1", 1, 400000), demo.WIDTH)
    return out.select(*[F.col(c).cast("double").alias(c) for c in ("x0", "x1", "y0", "y1")], "count", "colour")


@query(f"{_CELLS}{_ENDS} SELECT (s1 - 0.5 + s2 - 0.5) / 2 AS x, CAST(s1 - s2 AS DOUBLE) AS y, total AS count FROM ends WHERE chr1 = 'chr1' AND chr2 = 'chr1' AND s1 <= 500000 AND e1 >= 1 AND s2 <= 500000 AND e2 >= 1")
def v2_turned(spark, sf_dir):
    out = geometry.turned(demo.pairs(spark, sf_dir), demo.param(spark, sf_dir), ("chr1", 1, 500000), demo.WIDTH)
    corner = F.get("corners", F.lit(0))
    return out.select(corner["x"].cast("double").alias("x"), corner["y"].alias("y"), "count")


_FC = ", fd AS (SELECT *, (a1 + a2) % 9 - 4.0 AS fc FROM ends)"
_TWO_SIDED = "CASE WHEN fc >= 0 THEN printf('#FF%02X%02X', CAST(round(255 - 255 * fc / 4.0) AS INT), CAST(round(255 - 255 * fc / 4.0) AS INT)) ELSE printf('#%02X%02XFF', CAST(round(255 + 255 * fc / 4.0) AS INT), CAST(round(255 + 255 * fc / 4.0) AS INT)) END AS colour"
_BESIDE = "chr{i} = 'chr1' AND s{i} <= 500000 + 25100 AND e{i} >= 1 - 25100"


@query(
    f"{_CELLS}{_ENDS}{_FC}, rw AS ("
    + " UNION ".join(f"SELECT s{i} - 0.5 AS x0, e{i} + 0.5 AS x1, s{j} - 0.5 AS y0, e{j} + 0.5 AS y1, fc FROM fd WHERE {_BESIDE.format(i=1)} AND {_BESIDE.format(i=2)}" for i, j in ((1, 2), (2, 1)))
    + f") SELECT CAST(x0 AS DOUBLE) AS x0, CAST(x1 AS DOUBLE) AS x1, CAST(y0 AS DOUBLE) AS y0, CAST(y1 AS DOUBLE) AS y1, CAST(fc AS DOUBLE) AS fc, {_TWO_SIDED} FROM rw"
)
def v3_differential_plaid(spark, sf_dir):
    data = _square(spark, sf_dir)
    fc = data.pairs.select("a1", "a2", (F.pmod(F.col("a1") + F.col("a2"), F.lit(9)) - 4.0).alias("fc"))
    out = geometry.differential_plaid(data, fc, ("chr1", 1, 500000), limit=4.0)
    return out.select(*[F.col(c).cast("double").alias(c) for c in ("x0", "x1", "y0", "y1", "fc")], "colour")


@query(f"{_CELLS}{_ENDS}{_FC} SELECT CAST((s1 + s2 - 1) / 2.0 AS DOUBLE) AS x, CAST(s1 - s2 AS DOUBLE) AS y, CAST(fc AS DOUBLE) AS fc, {_TWO_SIDED} FROM fd WHERE chr1 = 'chr1' AND chr2 = 'chr1' AND s1 <= 500000 + 280000 AND e2 >= 1 - 280000")
def v4_differential_turned(spark, sf_dir):
    data = _square(spark, sf_dir)
    fc = data.pairs.select("a1", "a2", (F.pmod(F.col("a1") + F.col("a2"), F.lit(9)) - 4.0).alias("fc"))
    out = geometry.differential_turned(data, fc, ("chr1", 1, 500000), 400000, limit=4.0)
    corner = F.get("corners", F.lit(0))
    return out.select(corner["x"].cast("double").alias("x"), corner["y"].cast("double").alias("y"), F.col("fc").cast("double").alias("fc"), "colour")


@query(f"{_CELLS} SELECT a1, a2, lib, CAST(n AS BIGINT) AS count FROM (UNPIVOT cells ON c_A, c_N, c_R INTO NAME lib0 VALUE n), LATERAL (SELECT right(lib0, 1) AS lib)")
def dge_counts(spark, sf_dir):
    return counts.as_dge(_square(spark, sf_dir))[0]


@query(" SELECT lib, CAST(1 AS INT) AS \"group\", count(*) AS lib_size, CAST(1.0 AS DOUBLE) AS norm_factors FROM pairs GROUP BY lib")
def dge_samples(spark, sf_dir):
    return counts.as_dge(_square(spark, sf_dir))[1]


@query(" SELECT region_id, region_id AS margin FROM reg")
def j5_match_margins(spark, sf_dir):
    bins = durable(counts.bin_regions(counts.fragment_bins(demo.fragments(spark, sf_dir), demo.WIDTH)))
    diagonal = bins.select(F.col("region_id").alias("a1"), F.col("region_id").alias("a2"))
    return results.match_margins(diagonal, bins, bins).select(F.col("a1").alias("region_id"), F.col("margin1").alias("margin"))


_S1 = """, rd AS (SELECT *, pos1 % 11 = 0 AS dup, pos2 % 13 = 0 AS un FROM near),
mk AS (SELECT *, NOT un AND NOT dup AS ok, CASE WHEN len1 < 0 THEN pos2 ELSE pos1 END AS f5, CASE WHEN len1 < 0 THEN pos1 + 9 ELSE pos2 + 9 END AS r5, id1 = id2 AND (len1 < 0) <> (len2 < 0) AS same FROM rd)"""


def _alignments(spark, sf_dir):
    """Two alignments per read pair; some duplicates, some unmapped mates."""
    p = demo.pairs(spark, sf_dir, near=True).withColumn("qname", F.monotonically_increasing_id().cast("string"))
    flag1 = 65 + F.when(F.col("anchor1_len") < 0, 16).otherwise(0) + F.when(F.col("anchor1_pos") % 11 == 0, 1024).otherwise(0)
    flag2 = 129 + F.when(F.col("anchor2_len") < 0, 16).otherwise(0) + F.when(F.col("anchor2_pos") % 13 == 0, 4).otherwise(0)
    one = F.struct(flag1.alias("flag"), F.col("chr1").alias("chr"), F.col("anchor1_pos").alias("pos"))
    two = F.struct(flag2.alias("flag"), F.col("chr2").alias("chr"), F.col("anchor2_pos").alias("pos"))
    return durable(p.select("qname", F.explode(F.array(one, two)).alias("x")).select("qname", "x.*", F.lit(60).alias("mapq"), F.lit("10M").alias("cigar")))


@query(f"{_S1} SELECT count(*) AS total, count(*) FILTER (dup) AS marked, count(*) FILTER (un) AS filtered, count(*) FILTER (ok) AS mapped, count(*) FILTER (ok AND same AND r5 >= f5) AS dangling, count(*) FILTER (ok AND same AND r5 < f5) AS self_circle FROM mk")
def s1_prepare_pairs(spark, sf_dir):
    totals = alignments.prepare_pairs(_alignments(spark, sf_dir), demo.fragments(spark, sf_dir))[1]
    return totals.select("total", "marked", "filtered", "mapped", "dangling", "self_circle")


@query(f"{_S1}, kp AS (SELECT * FROM mk WHERE ok AND NOT same) SELECT id1 AS anchor1_id, id2 AS anchor2_id, count(*) AS n FROM kp GROUP BY ALL")
def s1_prepared_pairs(spark, sf_dir):
    pairs = alignments.prepare_pairs(_alignments(spark, sf_dir), demo.fragments(spark, sf_dir))[0]
    return pairs.groupBy(F.col("anchor1_id").cast("long").alias("anchor1_id"), F.col("anchor2_id").cast("long").alias("anchor2_id")).agg(F.count(F.lit(1)).alias("n"))


@query(f"{_S1} SELECT count(*) AS total, count(*) FILTER (ok) AS mapped, CAST(0 AS BIGINT) AS dangling, sum(pos1 + pos2) FILTER (ok) AS places FROM mk")
def s2_prepare_pairs_dnase(spark, sf_dir):
    pairs, totals = alignments.prepare_pairs(_alignments(spark, sf_dir), chromosomes=_lengths(spark, sf_dir))
    places = pairs.agg(F.sum(F.col("anchor1_pos") + F.col("anchor2_pos")).alias("places"))
    return totals.select("total", "mapped", "dangling", F.lit(places.first()["places"]).alias("places"))

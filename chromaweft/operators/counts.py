"""Counting pairs over bins, regions, patches, margins and domains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chromaweft.functions.interval import five_prime, interval_join
from chromaweft.operators.ordered import numbered
from chromaweft.operators.scan import scan
from chromaweft.plans.param import Interactions, PairParam


def restricted_names(restrict: tuple) -> set[str]:
    return {x for r in restrict for x in ((r,) if isinstance(r, str) else r)}


def on_restricted(regions: DataFrame, param: PairParam) -> DataFrame:
    """Regions on the restricted chromosomes (all, without a restriction); `original` still tells their first places."""
    names = restricted_names(param.restrict)
    return regions.filter(F.col("chr").isin(*names)) if names else regions


def fragment_bins(fragments: DataFrame, width: int, restrict: tuple = ()) -> DataFrame:
    """frag_id, bin: runs of fragments whose middles share a width, numbered over all chromosomes in order."""
    if width < 0:
        raise ValueError("width must not be negative")
    names = restricted_names(restrict)
    used = fragments.filter(F.col("chr").isin(*names)) if names else fragments
    raw = F.floor(((F.col("start") + F.col("end")) / 2 - 0.1) / width) if width else F.col("frag_id")
    # numbered within chromosomes, then shifted by the chromosomes before: no window over the whole genome
    local = used.withColumn("raw", raw).withColumn("k", F.dense_rank().over(Window.partitionBy("chr_idx").orderBy("raw")))
    sizes = local.groupBy(F.col("chr_idx").alias("ci")).agg(F.max("k").alias("n"))
    shift = sizes.select("ci", (F.sum("n").over(Window.orderBy("ci")) - F.col("n")).alias("shift"))
    return local.join(shift, F.col("chr_idx") == F.col("ci")).select("frag_id", "chr", "chr_idx", "start", "end", (F.col("k") + F.col("shift")).cast("long").alias("bin"))


def bin_regions(bins: DataFrame) -> DataFrame:
    return bins.groupBy(F.col("bin").alias("region_id")).agg(F.first("chr").alias("chr"), F.first("chr_idx").alias("chr_idx"), F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("nfrags"))


def regular_bins(chromosomes: DataFrame, width: int) -> DataFrame:
    """Bins of a genome without fragments; the last of a chromosome is cut at its end."""
    counted = chromosomes.withColumn("n", F.ceil(F.col("length") / width))
    shifted = counted.withColumn("shift", F.sum("n").over(Window.orderBy("chr_idx")) - F.col("n"))
    each = shifted.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return each.select((F.col("shift") + F.col("k")).alias("region_id"), "chr", "chr_idx", ((F.col("k") - 1) * width + 1).cast("int").alias("start"), F.least(F.col("k") * width, F.col("length")).cast("int").alias("end"), F.lit(0).cast("long").alias("nfrags"))


def read_bin(pos: Column, length: Column, width: int, chr_length: Column) -> Column:
    """0-based bin of a read's 5' end; a reverse read's end is kept within the chromosome, a start beyond it is an error."""
    end = F.when(length < 0, F.least(five_prime(pos, length), chr_length)).otherwise(pos)
    sound = F.when(pos <= chr_length, end).otherwise(F.raise_error(F.lit("read beyond its chromosome")).cast("int"))
    return F.ceil(sound / width) - 1


def binned_pairs(pairs: DataFrame, param: PairParam, width: int, restrict_regions: bool = False) -> tuple[DataFrame, DataFrame]:
    """(lib, a1, a2 with a1 >= a2; regions)."""
    seen = scan(pairs, param)
    if param.dnase:
        chromosomes = on_restricted(param.chromosomes, param) if restrict_regions else param.chromosomes
        regions = regular_bins(chromosomes, width)
        base = chromosomes.withColumn("n", F.ceil(F.col("length") / width)).withColumn("shift", F.sum("n").over(Window.orderBy("chr_idx")) - F.col("n"))
        one = base.select(F.col("chr").alias("chr1"), F.col("length").alias("__l1"), F.col("shift").alias("__s1"))
        two = base.select(F.col("chr").alias("chr2"), F.col("length").alias("__l2"), F.col("shift").alias("__s2"))
        seen = seen.join(one, "chr1").join(two, "chr2")
        x = F.col("__s1") + 1 + read_bin(F.col("anchor1_pos"), F.col("anchor1_len"), width, F.col("__l1"))
        y = F.col("__s2") + 1 + read_bin(F.col("anchor2_pos"), F.col("anchor2_len"), width, F.col("__l2"))
        return seen.select("lib", F.greatest(x, y).alias("a1"), F.least(x, y).alias("a2")), regions
    bins = fragment_bins(param.fragments, width, param.restrict if restrict_regions else ())
    look = bins.select("frag_id", "bin")
    out = seen.select("lib", "anchor1_id", "anchor2_id").join(look.withColumnRenamed("frag_id", "anchor1_id").withColumnRenamed("bin", "a1"), "anchor1_id")
    out = out.join(look.withColumnRenamed("frag_id", "anchor2_id").withColumnRenamed("bin", "a2"), "anchor2_id")
    return out.select("lib", "a1", "a2"), bin_regions(bins)


def total_counts(pairs: DataFrame, param: PairParam, libraries: tuple[str, ...]) -> DataFrame:
    """Pairs per library after restrict, discard and cap; libraries without pairs have 0."""
    names = pairs.sparkSession.createDataFrame([(x,) for x in libraries], "lib string")
    found = scan(pairs, param).groupBy("lib").agg(F.count(F.lit(1)).alias("n"))
    return names.join(found, "lib", "left").select("lib", F.coalesce("n", F.lit(0)).alias("total"))


def tabulate(binned: DataFrame, libraries: tuple[str, ...], least: int = 1) -> DataFrame:
    """a1, a2, counts: one shuffle, combined on the map side."""
    counts = [F.count_if(F.col("lib") == x).alias(f"__{i}") for i, x in enumerate(libraries)]
    wide = binned.groupBy("a1", "a2").agg(*counts)
    slots = [F.col(f"__{i}") for i in range(len(libraries))]
    kept = wide.filter(sum(slots[1:], slots[0]) >= least) if least > 0 else wide
    return kept.select("a1", "a2", F.array(*slots).alias("counts"))


def square_counts(pairs: DataFrame, param: PairParam, libraries: tuple[str, ...], width: int = 50000, least: int = 1, restrict_regions: bool = False) -> Interactions:
    """Counts of bin pairs with at least `least` pairs over all libraries."""
    binned, regions = binned_pairs(pairs, param, width, restrict_regions)
    return Interactions(tabulate(binned, libraries, least), regions, libraries, total_counts(pairs, param, libraries), width)


def margin_counts(pairs: DataFrame, param: PairParam, libraries: tuple[str, ...], width: int = 50000, restrict_regions: bool = False) -> DataFrame:
    """region_id, counts: ends per bin, all bins kept; a pair within one bin adds two."""
    binned, regions = binned_pairs(pairs, param, width, restrict_regions)
    ends = binned.select("lib", F.explode(F.array("a1", "a2")).alias("bin"))
    counts = ends.groupBy("bin").agg(*[F.count_if(F.col("lib") == x).alias(f"__{i}") for i, x in enumerate(libraries)])
    out = regions.join(counts, F.col("region_id") == F.col("bin"), "left")
    return out.select(*regions.columns, F.array(*[F.coalesce(f"__{i}", F.lit(0)) for i in range(len(libraries))]).alias("counts"))


def domain_directions(pairs: DataFrame, param: PairParam, libraries: tuple[str, ...], width: int = 50000, span: int = 10) -> DataFrame:
    """region_id, up, down: pairs with the next and the former `span` bins of the chromosome, the diagonal left out."""
    binned, regions = binned_pairs(pairs, param, width)
    look = regions.select(F.col("region_id").alias("__r"), F.col("chr_idx").alias("__c"))
    close = binned.filter((F.col("a1") - F.col("a2") >= 1) & (F.col("a1") - F.col("a2") <= span))
    counts = close.groupBy("a1", "a2").agg(*[F.count_if(F.col("lib") == x).alias(f"__{i}") for i, x in enumerate(libraries)])
    counts = counts.join(look.select(F.col("__r").alias("a1"), F.col("__c").alias("c1")), "a1").join(look.select(F.col("__r").alias("a2"), F.col("__c").alias("c2")), "a2").filter("c1 = c2")
    sides = counts.select(*[f"__{i}" for i in range(len(libraries))], F.explode(F.array(F.struct(F.col("a1").alias("bin"), F.lit("down").alias("side")), F.struct(F.col("a2").alias("bin"), F.lit("up").alias("side")))).alias("x"))
    sums = [F.sum(F.when(F.col("x.side") == s, F.col(f"__{i}")).otherwise(0)).alias(f"{s}{i}") for s in ("up", "down") for i in range(len(libraries))]
    found = sides.groupBy(F.col("x.bin").alias("bin")).agg(*sums)
    out = regions.join(found, F.col("region_id") == F.col("bin"), "left")
    return out.select(*regions.columns, *[F.array(*[F.coalesce(f"{s}{i}", F.lit(0)) for i in range(len(libraries))]).alias(s) for s in ("up", "down")])


def _window(a: str, region: tuple[str, int, int]) -> Column:
    chrom, start, end = region
    return (F.col(f"{a}_chr") == chrom) & (F.col(f"{a}_start") <= end) & (F.col(f"{a}_end") >= start)


def extract_patch(pairs: DataFrame, param: PairParam, first: tuple[str, int, int], second: tuple[str, int, int] | None = None, width: int = 10000, restrict_regions: bool = False) -> DataFrame:
    """a1, a2, count, flipped of the bin pairs between two regions; within a chromosome either way round.

    The chromosomes and the regions' ranges of fragments are pushed into the scan, and pairs meet the regions' bins only.
    With restrict_regions, bins are numbered over the two chromosomes alone.
    """
    second = second or first
    names = (first[0], second[0])
    param = param.reform(restrict=(names,))
    _, regions = binned_pairs(pairs.limit(0), param, width, restrict_regions)
    r = regions.select("region_id", "chr", "start", "end")
    one = r.toDF("a1", "a1_chr", "a1_start", "a1_end")
    two = r.toDF("a2", "a2_chr", "a2_start", "a2_end")
    near = _window("a1", first) & _window("a2", second)
    far = _window("a1", second) & _window("a2", first)
    narrow = pairs
    if not param.dnase:
        bins = fragment_bins(param.fragments, width)
        own = bins.groupBy("bin").agg(F.first("chr").alias("w_chr"), F.min("start").alias("w_start"), F.max("end").alias("w_end"), F.min("frag_id").alias("low"), F.max("frag_id").alias("high"))
        span = own.agg(*[f(F.when(_window("w", w), F.col(c))).alias(f"{c}{i}") for i, w in enumerate((first, second)) for f, c in ((F.min, "low"), (F.max, "high"))]).first()  # four numbers
        if span["low0"] is None or span["low1"] is None:
            narrow = pairs.filter(F.lit(False))
        else:
            x, y = (span["low0"], span["high0"]), (span["low1"], span["high1"])
            narrow = pairs.filter((F.col("anchor1_id").between(*x) & F.col("anchor2_id").between(*y)) | (F.col("anchor1_id").between(*y) & F.col("anchor2_id").between(*x)))
    binned, _ = binned_pairs(narrow, param, width, restrict_regions)
    counts = binned.groupBy("a1", "a2").agg(F.count(F.lit(1)).alias("count"))
    return counts.join(one, "a1").join(two, "a2").filter(near | far).select("a1", "a2", "count", (~near).alias("flipped"))


def connect_counts(pairs: DataFrame, param: PairParam, regions: DataFrame, libraries: tuple[str, ...], least: int = 1, kind: str = "any", second: DataFrame | int | None = None, restrict_regions: bool = False) -> Interactions:
    """Pairs between regions (original, chr, start, end): each pair once per pair of regions that it links.

    Regions are stretched to the fragments they overlap and sorted; with `second`, one end lies in each set. A number as `second`
    stands for the genome's bins of that width, whose `original` is null. With restrict_regions, regions and bins on other
    chromosomes than the restricted ones are left out.
    """
    def chosen(df: DataFrame, number: int) -> DataFrame:
        df = on_restricted(df, param) if restrict_regions else df
        return df.select(F.lit(number).alias("set"), F.col("original").cast("long").alias("key"), F.col("original").cast("long").alias("original"), "chr", "start", "end")

    rows = chosen(regions, 1)
    if isinstance(second, DataFrame):
        rows = rows.unionByName(chosen(second, 2))
    of_bins = None
    if param.dnase:
        order = param.chromosomes.select("chr", "chr_idx")
        stretched = rows.join(order, "chr").withColumn("nfrags", F.lit(0).cast("long"))
        if isinstance(second, int):
            of_bins = regular_bins(on_restricted(param.chromosomes, param) if restrict_regions else param.chromosomes, second)
    else:
        frag = param.fragments.select(F.col("frag_id"), F.col("chr").alias("l_chr"), F.col("start").alias("l_start"), F.col("end").alias("l_end"))
        hits = interval_join(frag, rows.select("set", "key", F.col("chr").alias("r_chr"), F.col("start").alias("r_start"), F.col("end").alias("r_end")), kind)
        wide = hits.groupBy("set", "key").agg(F.min("l_start").alias("s"), F.max("l_end").alias("e"), F.count(F.lit(1)).alias("nf"))
        order = param.fragments.select("chr", "chr_idx").distinct()
        stretched = rows.join(order, "chr").join(wide, ["set", "key"], "left")
        stretched = stretched.select("set", "key", "original", "chr", "chr_idx", F.coalesce("s", "start").alias("start"), F.coalesce("e", "end").alias("end"), F.coalesce("nf", F.lit(0)).alias("nfrags"))
        hits = hits.select("set", "key", "frag_id")
        if isinstance(second, int):
            bins = fragment_bins(param.fragments, second, param.restrict if restrict_regions else ())
            of_bins = bin_regions(bins)
            hits = hits.unionByName(bins.select(F.lit(2).alias("set"), F.col("bin").alias("key"), "frag_id"))
    if of_bins is not None:
        made = of_bins.select(F.lit(2).alias("set"), F.col("region_id").alias("key"), F.lit(None).cast("long").alias("original"), "chr", "chr_idx", "start", "end", "nfrags")
        stretched = stretched.select(*made.columns).unionByName(made)
    out = numbered(stretched.withColumn("chr_idx", F.col("chr_idx").cast("int")), "chr_idx", "start", "end", "set", "key", out="region_id")
    seen, slots = scan(pairs, param), [f"__{i}" for i in range(len(libraries))]
    tallies = [F.count_if(F.col("lib") == x).alias(s) for s, x in zip(slots, libraries)]
    if param.dnase:
        # pairs at the same places are counted once; each end then meets its regions in turn
        place = ["chr1", "anchor1_pos", "anchor1_len", "chr2", "anchor2_pos", "anchor2_len"]
        linked = seen.groupBy(*place).agg(*tallies)
        right = out.select("region_id", "set", F.col("chr").alias("r_chr"), F.col("start").alias("r_start"), F.col("end").alias("r_end"))
        for i, (x, s) in enumerate((("x", "sx"), ("y", "sy")), 1):
            left = linked.withColumns({"l_chr": F.col(f"chr{i}"), "l_start": F.col(f"anchor{i}_pos"), "l_end": F.col(f"anchor{i}_pos") + F.abs(f"anchor{i}_len") - 1})
            linked = interval_join(left, right, kind).withColumnRenamed("region_id", x).withColumnRenamed("set", s).drop("l_chr", "l_start", "l_end", "r_chr", "r_start", "r_end")
    else:
        # many pairs join two fragments: count them first, then spread the counts over the regions
        place = ["anchor1_id", "anchor2_id"]
        counted = seen.groupBy(*place).agg(*tallies)
        touch = hits.join(out.select("set", "key", "region_id"), ["set", "key"]).select("set", "frag_id", "region_id")
        linked = counted.join(touch.toDF("sx", "anchor1_id", "x"), "anchor1_id").join(touch.toDF("sy", "anchor2_id", "y"), "anchor2_id")
    linked = linked.filter("sx <> sy") if second is not None else linked
    once = linked.select(*place, F.greatest("x", "y").alias("a1"), F.least("x", "y").alias("a2"), *slots).distinct()
    sums = once.groupBy("a1", "a2").agg(*[F.sum(s).alias(s) for s in slots])
    total = sum((F.col(s) for s in slots[1:]), F.col(slots[0]))
    return Interactions(sums.filter(total >= least).select("a1", "a2", F.array(*slots).alias("counts")), out.drop("key"), libraries, total_counts(pairs, param, libraries))


def as_dge(data: Interactions) -> tuple[DataFrame, DataFrame]:
    """(counts in long form, samples: lib, group, lib_size, norm_factors)."""
    names = F.array(*[F.lit(x) for x in data.libraries])
    long = data.pairs.select("a1", "a2", F.posexplode("counts").alias("i", "count")).select("a1", "a2", F.get(names, F.col("i")).alias("lib"), "count")
    return long, data.totals.select("lib", F.lit(1).alias("group"), F.col("total").alias("lib_size"), F.lit(1.0).alias("norm_factors"))

"""Genomes: FASTA, chromosome lengths, in-silico digestion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chromaweft.functions.interval import interval_join

# fixed values: the IUPAC nucleotide codes and their complements
IUPAC = {"A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}
COMPLEMENT = str.maketrans("ACGTRYSWKMBDHVN", "TGCAYRSWMKVHDBN")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """chr, chr_idx, seq; a record is one row."""
    rows = spark.read.text(path, lineSep=">").filter(F.trim("value") != "").withColumn("i", F.monotonically_increasing_id())
    lines = F.split("value", r"\r?\n", 2)
    out = rows.select(F.regexp_extract(lines[0], r"^(\S+)", 1).alias("chr"), F.upper(F.regexp_replace(lines[1], r"\s", "")).alias("seq"), "i")
    return out.withColumn("chr_idx", F.row_number().over(Window.orderBy("i")) - 1).select("chr", "chr_idx", "seq")


def empty_genome(genome: DataFrame) -> DataFrame:
    """chr, chr_idx, length: a genome without fragments."""
    return genome.select("chr", "chr_idx", F.length("seq").alias("length"))


segment_genome = empty_genome


def cut_genome(genome: DataFrame, patterns: list[str], overhangs: list[int] | int = 4, piece: int = 1 << 20) -> DataFrame:
    """Restriction fragments frag_id, chr, chr_idx, start, end; those of several enzymes are intersected.

    Each hit at m (overlapping ones too) ends a fragment at m + rem - 1 + overhang and starts the next at m + rem, where rem =
    (pattern length - overhang) / 2. Sequences are searched in pieces that overlap by the pattern's length.
    """
    overhangs = [overhangs] * len(patterns) if isinstance(overhangs, int) else overhangs
    cut = None
    for pattern, overhang in zip(patterns, overhangs, strict=True):
        pattern = pattern.upper()
        n = len(pattern)
        if pattern != pattern.translate(COMPLEMENT)[::-1]:
            raise ValueError(f"{pattern} is not its own reverse complement")
        if not 0 <= overhang <= n or (n - overhang) % 2:
            raise ValueError("the overhang must fit the pattern, and both be even or both odd")
        rem = (n - overhang) // 2
        regex = "".join(f"[{IUPAC[c]}]" for c in pattern)
        pieces = genome.select("chr", "chr_idx", F.length("seq").alias("size"), "seq", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.length("seq") - 1), F.lit(piece))).alias("at"))
        text = F.substring("seq", F.col("at") + 1, F.lit(piece + n - 1))
        # a look-ahead matches without consuming: split at every position that begins a hit
        parts = pieces.withColumn("parts", F.split(text, f"(?={regex})")).withColumn("leads", text.rlike(f"^{regex}"))
        # every part but the first begins a hit; the first does if the text does
        begins = F.transform(F.sequence(F.lit(1), F.size("parts")), lambda k: F.aggregate(F.slice("parts", F.lit(1), k - 1), F.lit(0), lambda a, p: a + F.length(p)))
        hit = F.filter(begins, lambda b: (b > 0) | F.col("leads"))
        starts = parts.select("chr", "chr_idx", "size", F.explode(F.transform(hit, lambda b: F.col("at") + b + 1)).alias("m")).filter(F.col("m") + n - 1 <= F.col("size")).distinct()
        order = Window.partitionBy("chr").orderBy("m")
        ends = starts.select("chr", "chr_idx", "size", "m", F.lag("m").over(order).alias("before"))
        inner = ends.select("chr", "chr_idx", F.coalesce(F.col("before") + rem, F.lit(1)).alias("start"), (F.col("m") + rem - 1 + overhang).alias("end"))
        last = genome.select("chr", "chr_idx", F.length("seq").alias("size")).join(starts.groupBy("chr").agg(F.max("m").alias("m")), "chr", "left")
        tail = last.select("chr", "chr_idx", F.coalesce(F.col("m") + rem, F.lit(1)).alias("start"), F.col("size").alias("end"))
        digest = inner.union(tail)
        if cut is None:
            cut = digest
        else:
            left = cut.select(F.col("chr").alias("l_chr"), "chr_idx", F.col("start").alias("l_start"), F.col("end").alias("l_end"))
            right = digest.select(F.col("chr").alias("r_chr"), F.col("start").alias("r_start"), F.col("end").alias("r_end"))
            both = interval_join(left, right)
            cut = both.select(F.col("l_chr").alias("chr"), "chr_idx", F.greatest("l_start", "r_start").alias("start"), F.least("l_end", "r_end").alias("end")).distinct()
    number = F.row_number().over(Window.orderBy("chr_idx", "start", "end")).cast("int")
    return cut.select(number.alias("frag_id"), "chr", "chr_idx", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))

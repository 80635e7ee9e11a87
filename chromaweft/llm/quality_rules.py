"""Quality rules whose cut-offs are chosen under a guaranteed false-rejection risk.

Everything here is DataFrame expressions. `text_metrics` measures whole texts; `risk_controlled_cutoffs`
reads a labelled holdout and picks, per stratum and rule, the most aggressive cut-off of a grid fixed in
advance for which an exact binomial test shows that at most `risk / number of rules` of the good documents
are rejected; `apply_rules` gives the verdicts.

Testing: within a (stratum, rule) the grid is walked from the mildest cut-off to the harshest and stops at
the first that is not significant (fixed-sequence testing, which needs no correction). Over the
stratum x rule families the level is divided by their number (Bonferroni). The rules' risks add up, so a
stratum's total false-rejection rate is at most `risk` with probability 1 - delta.

Defined results: null or empty text has no words; a null stratum is a stratum of its own; a stratum without
good labelled rows gets no cut-offs and nothing in it is rejected by the method; repeated rows give repeated
results; labels that disagree count as good; labels of unknown documents are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chromaweft.llm.common import materialize

SEPARATORS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
RISK = 0.05
DELTA = 0.05

#: rule -> (numerator, denominator, direction, grid from mildest to harshest)
RULES = {
    "symbol_share": ("n_symbols", "word_chars", "above", [0.50, 0.40, 0.30, 0.25, 0.20, 0.15, 0.12, 0.10, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02, 0.01]),
    "dup_line_share": ("n_dup_lines", "n_lines", "above", [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05]),
    "repeat_share": ("n_repeat_words", "n_words", "above", [0.48, 0.45, 0.40, 0.35, 0.30, 0.25, 0.20, 0.15, 0.10, 0.05]),
    "long_words": ("word_chars", "n_words", "above", [40.0, 30.0, 25.0, 20.0, 16.0, 14.0, 12.0, 10.0, 9.0, 8.0]),
    "short_words": ("word_chars", "n_words", "below", [1.2, 1.5, 2.0, 2.5, 3.0, 3.5, 4.0]),
}


def _has_word(line: Column) -> Column:
    return F.length(F.btrim(line, F.lit(SEPARATORS))) > 0


def text_metrics(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines and n_repeat_words of each text."""
    body = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(*keep, body.alias("__t")).select("*", F.btrim(F.col("__t"), F.lit(SEPARATORS)).alias("__b"))
    words = F.when(F.length("__b") == 0, F.array().cast("array<string>")).otherwise(F.split("__b", r"[ \t-\r]+"))
    base = base.select(
        *keep,
        words.alias("__w"),
        F.filter(F.split("__t", "\n"), _has_word).alias("__l"),
        F.length(F.translate("__t", SEPARATORS, "")).cast("long").alias("word_chars"),
        (F.length("__t") - F.length(F.translate("__t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    windows = F.when(
        F.size("__w") >= 3,
        F.transform(F.sequence(F.lit(0), F.size("__w") - 3), lambda i: F.xxhash64(F.get("__w", i), F.get("__w", i + 1), F.get("__w", i + 2))),
    ).otherwise(F.array().cast("array<bigint>"))
    base = base.select(
        *keep,
        F.size("__w").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.size("__l").cast("long").alias("n_lines"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        windows.alias("__h"),
    )
    base = base.select("*", F.sort_array("__h").alias("__s"))
    # hashes that occur twice; a 64-bit mask of them spares most positions the exact look-up below
    base = base.select("*", F.array_distinct(F.filter("__s", lambda h, i: h == F.get("__s", i - 1))).alias("__d")).drop("__s")
    mask = F.aggregate("__d", F.lit(0).cast("bigint"), lambda m, d: m.bitwiseOR(_bit(d)))
    base = base.select("*", mask.alias("__m"))
    maybe = F.filter(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))), lambda x: F.col("__m").bitwiseAND(_bit(x["h"])) != 0)
    base = base.select("*", F.when(F.size("__d") == 0, F.array().cast("array<struct<h:bigint,i:int>>")).otherwise(F.sort_array(maybe)).alias("__c"))
    twice = F.filter("__c", lambda x, i: (x["h"] == F.get("__c", i - 1)["h"]) | (x["h"] == F.get("__c", i + 1)["h"]))
    covered = F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))
    return base.select(*keep, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", covered.cast("long").alias("n_repeat_words"))


def _bit(h: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(h, F.lit(64)).cast("int"))


def _share(numerator: str, denominator: str) -> Column:
    return F.when(F.col(denominator) > 0, F.col(numerator) / F.col(denominator)).otherwise(F.lit(0.0))


def rejected_by(rule: str, cutoff: Column) -> Column:
    numerator, denominator, direction, _ = RULES[rule]
    share = _share(numerator, denominator)
    hit = share > cutoff if direction == "above" else share < cutoff
    return F.coalesce((F.col(denominator) > 0) & hit, F.lit(False))


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Bin(n, p), summed exactly in log space; used only where k <= n * p."""
    odds = F.lit(p / (1 - p))
    first = n.cast("double") * F.log(F.lit(1 - p))
    start = F.struct(first.alias("term"), first.alias("total"))

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i + 1) / i * odds)
        high = F.greatest(term, acc["total"])
        low = F.least(term, acc["total"])
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("total"))

    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("bigint"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.least(F.lit(1.0), F.exp(F.aggregate(steps, start, step)["total"]))


def risk_controlled_cutoffs(good: DataFrame, stratum: str = "stratum", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """One row per stratum: a cut-off column per rule, null where no cut-off is safe.

    good: metrics of labelled good documents that the base rules pass, with the stratum.
    """
    share = risk / len(RULES)
    counts = [F.count(F.lit(1)).alias("n")]
    for rule, (_, _, _, grid) in RULES.items():
        counts.append(F.array(*[F.count_if(rejected_by(rule, F.lit(float(c)))) for c in grid]).alias(f"k_{rule}"))
    table = good.groupBy(stratum).agg(*counts)
    families = table.agg((F.count(F.lit(1)) * len(RULES)).alias("families"))
    table = table.crossJoin(families)  # one row: the number of families
    level = F.lit(delta) / F.col("families")
    out = [F.col(stratum)]
    for rule, (_, _, _, grid) in RULES.items():
        tests = F.transform(
            f"k_{rule}",
            lambda k: F.when(k <= F.col("n") * share, binomial_tail(k, F.col("n"), share)).otherwise(F.lit(1.0)) <= level,
        )
        # tests before the first failure
        first_bad = F.coalesce(F.array_position(tests, F.lit(False)), F.lit(0))
        passed = F.when(first_bad == 0, F.lit(len(grid))).otherwise(first_bad - 1).cast("int")
        grid_column = F.array(*[F.lit(float(c)) for c in grid])
        out.append(F.when(passed > 0, F.get(grid_column, passed - 1)).alias(f"cut_{rule}"))
    return table.select(*out)


def apply_rules(metrics: DataFrame, cutoffs: DataFrame, stratum: str = "stratum") -> DataFrame:
    """Adds base_failed, rejected_rules (names, comma-joined) and kept."""
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    right = cutoffs.withColumnRenamed(stratum, "__stratum")
    joined = metrics.join(right, F.col(stratum) == F.col("__stratum"), "left").drop("__stratum")
    names = F.concat_ws(",", *[F.when(rejected_by(r, F.col(f"cut_{r}")), F.lit(r)) for r in RULES])
    return (
        joined.withColumn("base_failed", base_failed)
        .withColumn("rejected_rules", names)
        .withColumn("kept", ~F.col("base_failed") & (F.col("rejected_rules") == ""))
        .drop(*[f"cut_{r}" for r in RULES])
    )


def score_documents(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """Metrics and verdicts of every row; the stratum is the language, null languages together."""
    named = docs.select("doc_id", "text", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("stratum"))
    metrics = materialize(text_metrics(named, keep=("doc_id", "stratum")), "quality-metrics")
    verdict = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    good = metrics.join(verdict.filter(F.col("quality") == 1).select("doc_id"), "doc_id", "left_semi")
    good = good.filter((F.col("n_words") >= 50) & (100 * F.col("n_repeat_words") <= 50 * F.col("n_words")))
    return apply_rules(metrics, risk_controlled_cutoffs(good, risk=risk, delta=delta))

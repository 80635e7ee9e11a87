"""Connected components of an edge table by large-star / small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chromaweft.plans.durable import discard, durable

#: A node's edges are spread over so many keys in the joins that name its smallest neighbour.
SALTS = 8


def _to_smallest(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Edges (a, b) as (b, m) with m of a in least (u, m); a hub's edges go to SALTS tasks."""
    spread = least.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = edges.withColumn("s", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    return salted.join(spread, (F.col("a") == F.col("u")) & (F.col("s") == F.col("r"))).select(F.col("b").alias("a"), F.col("m").alias("b"))


def connected_components(edges: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(node, component) of every node that has an edge (columns a, b); the component is its smallest node.

    Each round rewrites the edges towards the smallest neighbour and writes them to the shared folder; a hub's
    edges are rows, never one array. Ends when a round changes nothing; if max_rounds is given and does not suffice, that
    is an error.
    """
    edges = edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = durable(edges)
    seen, rounds = None, 0
    while True:
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b") % 1_000_000_007).alias("h")).first()
        if (state["n"], state["h"]) == seen or not state["n"]:
            break
        if rounds == max_rounds:
            raise RuntimeError(f"components are not done after {max_rounds} rounds")
        seen, rounds = (state["n"], state["h"]), rounds + 1
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = _to_smallest(both.filter("b > a"), least).filter("a <> b").distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        kept = small.select(F.col("u").alias("a"), F.col("m").alias("b"))
        last, edges = edges, durable(_to_smallest(large, small).union(kept).filter("a <> b").distinct())
        discard(last)
    leaves = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return leaves.union(roots.join(leaves.select(F.col("node").alias("x")), F.col("node") == F.col("x"), "left_anti"))

"""Connected components of an edge table by alternating stars (one shuffle join per star)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage, shuffled


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node reachable.

    Each round hangs every larger neighbour on the smallest one (large star) and then every
    smaller one on the smallest (small star); the number of rounds is logarithmic in practice
    and the loop runs to the fixed point.  Self loops and repeated edges are allowed, edges
    with a null end are ignored, an empty table gives an empty result.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(
        f"`{a}` IS NOT NULL AND `{b}` IS NOT NULL AND u <> v").distinct()
    e = cut_lineage(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(shuffled(low), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(shuffled(low), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e = cut_lineage(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        inner = e.join(shuffled(e.select(F.col("u").alias("v")).distinct()), "v", "left_semi")
        n = e.agg(F.count("*").alias("n"), F.countDistinct("u").alias("d")).first()
        if n["n"] == n["d"] and inner.isEmpty():
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

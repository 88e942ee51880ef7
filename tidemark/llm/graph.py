"""Connected components of an edge table, without any component in one task or on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that an edge (a, b) names; the root is the smallest node of its component.

    Alternating star contraction: every node hands its neighbours to its smallest neighbour, first the larger ones and then
    the smaller ones, until each component is one star. The rounds grow with the logarithm of the nodes.
    """
    e = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("_a")).agg(F.min("b").alias("m")).select("_a", F.least("_a", "m").alias("m"))
        large = both.join(least, both["a"] == least["_a"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = cut_lineage(large.distinct())
        low = large.groupBy(F.col("a").alias("_a")).agg(F.min("b").alias("m"))
        small = large.join(low, large["a"] == low["_a"]).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = cut_lineage(small.union(low.select("_a", "m")).distinct())
        # two numbers tell whether the edges have changed
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            break
        before = now
    roots = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(e.select("b", "b").distinct())

"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..session import cut_lineage


def _stars(edges: DataFrame) -> tuple[DataFrame, dict]:
    """The edges as a table, and a digest of the set of edges."""
    seen, mark = Observation(), F.xxhash64("a", "b")
    table = cut_lineage(edges.observe(
        seen, F.count(F.lit(1)).alias("n"), F.bit_xor(mark).alias("x"), F.sum(mark.bitwiseAND(F.lit(2**30 - 1))).alias("s")), "stars")
    return table, dict(seen.get)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the smallest
    node of the component. Nodes without an edge do not appear.

    Each round hangs neighbours under the smallest node seen, first larger ones
    (large star), then smaller ones (small star); rounds grow with the logarithm
    of the component's size. Minima are pre-aggregated, and the join that hands
    them out is a plain equi join that Spark can split on hot nodes. Every round
    is a table in the shared folder.
    """
    edges, before = _stars(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(
            F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        edges, after = _stars(small.select("e.*").filter("a <> b").distinct())
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())

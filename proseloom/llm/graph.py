"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proseloom.session import cut_lineage


def _lowest(edges: DataFrame) -> DataFrame:
    """Least neighbour of every node; written, so that a join with it can split a hot node."""
    return cut_lineage(edges.groupBy("a").agg(F.min("b").alias("low")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the least node of its component.

    Each round is two aggregations with map-side combine and two equi-joins
    over the edges; the edges shrink to one star per component.  Loops are
    ignored, repeated edges count once, and an empty table gives an empty one.
    """
    ab = [F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")]
    edges = cut_lineage(edges.where("a <> b").select(*ab).distinct())
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = _lowest(both).select("a", F.least("a", "low").alias("low"))
        large = cut_lineage(
            both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        )
        low = _lowest(large)
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("low"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("low").alias("b"))
        edges = cut_lineage(small.where("a <> b").distinct())
        sign = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sign == seen:
            break
        seen = sign
    roots = edges.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)

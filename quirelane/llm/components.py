"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelane.session import cut


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, root) for every node that has an edge to another; root is the smallest node of its component.

    Each round joins the edges with the smallest neighbour of one end: a row per node, so no neighbour list is ever
    gathered. Both sides of these joins are materialised first, so that adaptive execution may split a hub's rows.
    Null ends and self-loops are dropped; repeated edges count once; an empty table gives an empty result.
    """
    e = edges.where(F.col(src) != F.col(dst)).select(F.greatest(src, dst).alias("a"), F.least(src, dst).alias("b"))
    e = cut(e.distinct())
    state = _state(e)
    while state[0]:
        ends = e.select(F.col("b").alias("u"), F.col("a").alias("v")).union(e.select(F.col("a").alias("u"), F.col("b").alias("v")))
        least = cut(ends.groupBy("u").agg(F.min("v").alias("m")))
        # large star: each larger neighbour of u goes to the smallest of u's neighbourhood
        e = e.join(least, e["b"] == least["u"]).select("a", F.least("b", "m").alias("b")).distinct()
        e = cut(e)
        # small star: u and its smaller neighbours go to the smallest of these
        least = cut(e.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")))
        moved = e.join(least, e["a"] == least["u"]).where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = cut(moved.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct())
        new = _state(e)
        if new == state:
            break
        state = new
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select("b", "b").distinct())

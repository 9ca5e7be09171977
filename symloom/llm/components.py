"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.llm.common import materialise


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a, b) of one orderable type to (node, root), root the smallest node that can be reached; nodes with edges only.

    Each round hangs every larger neighbour of a node below the smallest one (large star), then every node and its
    smaller neighbours below the smallest of those (small star). Edges never grow in number, minima are combined
    before the shuffle, and no neighbour list is ever held. Rounds end as soon as the edges are stars, which is counted:
    a round that only shows that nothing changes would write four tables more.
    """
    e = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    for _ in range(max_rounds):
        if _is_stars(e):
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Minima are written, so that adaptive execution can split a large star's edges in the join.
        low = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "large-star-minima")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialise(large, "large-star")
        low = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "small-star-minima")
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        e = materialise(small, "small-star")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _is_stars(e: DataFrame) -> bool:
    """Whether every node hangs below one smaller node, below which nothing but leaves hangs: no round would change that."""
    ends = e.select(F.col("u").alias("node"), F.lit(1).alias("below")).union(e.select(F.col("v").alias("node"), F.lit(0).alias("below")))
    other = ends.groupBy("node").agg(F.sum("below").alias("below"), F.count(F.lit(1)).alias("n")).where("below > 0 and n > 1")
    return other.agg(F.count(F.lit(1))).first()[0] == 0

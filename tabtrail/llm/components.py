"""Connected components of a large graph by alternating large-star and small-star steps.

Every step is a grouped minimum (combined on the map side) and an equi-join whose other side
is unique, so a hub's rows can be split by the planner; nothing is collected per node. The
edges are written to the shared checkpoint folder after each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tabtrail.session import checkpoint_dir


def _towards_min(pairs: DataFrame) -> DataFrame:
    """(a, b) -> (a, b, m): m is the smallest of a and all its b."""
    low = pairs.groupBy("a").agg(F.min("b").alias("low"))
    return pairs.join(low, "a").select("a", "b", F.least("a", "low").alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a bigint, b bigint) -> (node, root): each node that has an edge, with the
    smallest node of its component. Self-loops and null ends are ignored."""
    checkpoint_dir(edges.sparkSession)
    now = (edges.where(F.col("a") != F.col("b"))
           .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
           .distinct().checkpoint())
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.col("a").cast("decimal(20,0)")),
                        F.sum(F.col("b").cast("decimal(20,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = (_towards_min(both).where("b > a AND b != m")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        small = _towards_min(large)
        now = (small.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
               .unionByName(small.select("a", F.col("m").alias("b"))).distinct().checkpoint())
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))
                             .distinct())

"""Connected components of a link table by star contraction.

Every round is a few shuffles of the remaining links and ends in a written
table, so a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstile.llm.scratch import Scratch


def connected_components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` to ``(id, component)``: the smallest id reachable.

    Only ids that occur in a link are returned.  Self links and repeats are
    allowed; nulls are ignored.  Rounds alternate a large-star step (larger
    neighbours move to the smallest neighbour) with a small-star step, both
    plain grouped aggregates without a list per node, until no edge changes.
    The number of rounds grows with the logarithm of the longest chain.  Joins
    are hinted to merge: their sides are grouped by the same column, and a
    broadcast in every round would fill the driver.
    """
    edges = (links.where("a is not null and b is not null and a <> b")
             .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    scratch = Scratch(links.sparkSession, "components")
    edges = scratch.write(edges, "edges")
    while not edges.isEmpty():
        # large star: every larger neighbour of a node is linked to the node's smallest neighbour
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = scratch.write(both.where("v > u").join(least.hint("merge"), "u")
                              .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        # small star: smaller neighbours and the node itself go to the smallest neighbour
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = scratch.write(large.join(least.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                              .union(least.select("u", F.col("m").alias("v"))).distinct(), "small")
        scratch.drop(edges, large)
        edges = small
        # done when every node points straight at one root: a target that is a source, or a source of two targets, goes on
        inner = small.groupBy("u").agg(F.count("*").alias("n"))
        if inner.where("n > 1").isEmpty() and small.join(inner.select(F.col("u").alias("v")).hint("merge"), "v", "left_semi").isEmpty():
            break
    return (edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
            .union(edges.select("v", "v").distinct()))

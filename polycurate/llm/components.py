"""Connected components of an edge table, by contraction: every round each node moves to its least neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node with an edge; component is the least node that it reaches. edges: (a, b), in any order.

    A round at least halves the nodes that still have edges, so the rounds grow with the logarithm of the largest component.
    """
    edges = written(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    found, depth = None, 0
    while edges.limit(1).count():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        moves = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("to")).select(F.col("a").alias("node"), "to"), "moves")
        if found is None:
            now = moves.select("node", F.col("to").alias("component"))
        else:
            now = found.join(moves.select(F.col("node").alias("component"), "to"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        now = written(now, "found")
        ends = edges.join(moves.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").join(moves.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        following = written(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).filter("a <> b").distinct(), "edges")
        for old in (edges, moves, found):
            if old is not None:
                discard(old)
        edges, found, depth = following, now, depth + 1
    if found is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return found

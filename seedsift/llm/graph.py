"""Connected components by repeated contraction, for graphs of any size and shape."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedsift.llm.common import settle


def contract(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected ``edges`` (a, b): two nodes have one root
    exactly when they are connected.

    In each round every node points to its neighbour that comes first in an order drawn anew, or to
    itself, and the edges are rewritten to what their ends point to. The expected number of nodes
    that are left shrinks by a constant factor, whatever the shape, so a chain of a billion nodes
    takes some dozens of rounds. Pointers are found by aggregates with partial sums on the map
    side; only edges between different roots go on. The driver sees nothing but the question
    whether an edge is left.
    """
    edges = settle(edges.select("a", "b").filter(F.col("a") != F.col("b")), "edges")
    steps = []
    while not edges.isEmpty():
        salt = F.lit(len(steps))
        both = edges.select("a", "b").union(edges.select("b", "a"))
        ranked = both.select(
            F.col("a").alias("node"), F.struct(F.xxhash64("b", salt), F.col("b").alias("to")).alias("r")
        )
        step = settle(
            ranked.groupBy("node")
            .agg(F.min("r").alias("r"))
            .withColumn("own", F.struct(F.xxhash64("node", salt), F.col("node").alias("to")))
            .select("node", F.least("r", "own")["to"].alias("root")),
            "pointers",
        )
        steps.append(step)
        ends = step.select(F.col("node").alias("a"), F.col("root").alias("p"))
        other = step.select(F.col("node").alias("b"), F.col("root").alias("q"))
        edges = settle(
            edges.join(ends, "a")
            .join(other, "b")
            .filter("p != q")
            .select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))
            .distinct(),
            "edges",
        )
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = steps[0]
    for step in steps[1:]:
        later = step.select(F.col("node").alias("root"), F.col("root").alias("later"))
        roots = roots.join(later, "root", "left").select(
            "node", F.coalesce("later", "root").alias("root")
        )
    return roots

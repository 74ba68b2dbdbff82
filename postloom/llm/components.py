"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.llm.base import checkpoint


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); nodes of a component share a root, one of them.

    Each round maps a node to the least of itself and its neighbours and draws the edges between what they map to, until
    none is left. Node keys should be hashes: with random keys the rounds grow as the logarithm of a component's
    diameter. All steps are combined before they are shuffled, and each round is written to the checkpoint folder.
    """
    edges = checkpoint(edges.filter("a <> b").select("a", "b").distinct())
    maps: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = checkpoint(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        maps.append(step)
        left, right = step.select("a", F.col("m").alias("x")), step.select(F.col("a").alias("b"), F.col("m").alias("y"))
        edges = checkpoint(edges.join(left, "a").join(right, "b").filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = maps[0].select(F.col("a").alias("node"), F.col("m").alias("root"))
    for step in maps[1:]:
        found = found.join(step.withColumnRenamed("a", "root"), "root", "left").select("node", F.coalesce("m", "root").alias("root"))
    return found

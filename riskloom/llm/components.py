"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import Steps


def components(links: DataFrame, steps: Steps, name: str) -> DataFrame:
    """node, root: each node of the links (columns a, b) but the roots, with the smallest node it is linked to by any path.

    A round hangs the larger neighbours of each node, then the smaller ones, on its smallest neighbour. Minima combine
    on the map side and neighbours are never collected, so a node may have any number of them. Rounds grow with the
    logarithm of the nodes; tables of links are all that is kept.
    """
    edges = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = steps.keep(edges, f"{name}-0")
    seen, turn = None, 0
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        turn += 1
        edges = steps.keep(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), f"{name}-{turn}")
        steps.drop(f"{name}-{turn - 1}")
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state

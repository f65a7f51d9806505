"""Connected components of a distributed edge table, by alternating star contractions.

Each round joins every node's links to its least neighbour; hubs are aggregated before the
shuffle and the join of a hub is left to adaptive skew handling. Nothing reaches the driver
but a count and a sum for each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderloom.llm import scratch


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Link neighbours to each node's least neighbour: the larger ones, or the smaller and itself."""
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        made = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        made = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return made.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has a link; root is the least node reachable. edges: a, b.

    Rounds go on until one changes nothing, which takes a number that grows with the logarithm of the nodes.
    """
    edges = scratch.stash(edges.filter("a <> b").select("a", "b").distinct(), "links")
    state = None
    while True:
        edges = scratch.stash(_stars(_stars(edges, True), False), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        state = tuple(now)

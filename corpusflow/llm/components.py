"""Connected components of a graph given as edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.session import materialise


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (the smallest node it reaches) for all nodes of edges ``a``, ``b`` (long).

    Each round joins every node's larger (then smaller) neighbours to its smallest one and is written,
    so that a lost task can't undo it; the number of edges never grows. A node that a third of all edges
    meet is only a key of aggregations that combine before the shuffle and the larger side of a join.
    """
    stars = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars")
    before = None
    while True:
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        # every edge now leads to a smaller node
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b")
        own = low.select("a", F.col("low").alias("b"))
        stars = materialise(small.unionByName(own).distinct(), "stars")
        state = stars.agg(F.count("*").alias("n"), F.sum(F.col("b").cast("decimal(38,0)")).alias("s")).first()
        if state == before:
            break
        before = state
    roots = stars.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)

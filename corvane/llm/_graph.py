"""Connected components by alternating stars, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm._common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (columns a, b), root being the smallest node reachable.

    Alternates large stars (each node's larger neighbours are linked to its smallest one) and small stars (its smaller
    neighbours are) until nothing changes: a number of rounds in the logarithm of the longest chain. Each round is
    written to the shared folder, so neither lineage nor driver grows with the graph.
    """
    edges = stored(_tidy(links), "links")
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _tidy(_star(both).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")))
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        small = _star(down)
        edges = stored(_tidy(small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b")))), "links")
        now = _state(edges)
        if now == state:
            break
        state = now
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _tidy(links: DataFrame) -> DataFrame:
    """Each link once, from the larger to the smaller node."""
    return links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _star(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return links.join(least, "a")


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]

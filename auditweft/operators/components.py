"""Connected components of a graph given as edges, by large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hydrate import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node that each node of the edges (a, b) is connected to.

    Every round ties neighbours to their least one, first those above a node, then those below; edges
    only get fewer or shorter, and rounds grow with the logarithm of the longest chain. It ends when a
    round changes nothing. Loops and repeated edges are harmless; no edges give no rows.
    """
    now = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    seen = mark(now)
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").filter("b > a AND b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("x"), F.col("m").alias("y")).union(least)
        now = cut(small.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).filter("a <> b").distinct())
        before, seen = seen, mark(now)
        if seen == before:
            break
    roots = now.select(F.col("b").alias("a")).distinct().select("a", F.col("a").alias("b"))
    return now.union(roots).select(F.col("a").alias("node"), F.col("b").alias("root"))

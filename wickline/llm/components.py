"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickline.llm.scratch import written


def _with_least(edges: DataFrame) -> DataFrame:
    """(u, v, m): every edge from both ends, with the least node at or next to u. The
    minimum is pre-aggregated, and the join back is one a hot node can be split in."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return both.join(least, "u")


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in ``links(u, v)``, the component being its
    smallest node. Alternates two kinds of stars until nothing changes: larger
    neighbours are hung on the least neighbour, then smaller ones; the number of
    rounds grows with the logarithm of the number of nodes. Loops are ignored."""
    edges = written(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    state = None
    while True:
        large = _with_least(edges).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        hung = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        edges = written(hung.filter("u <> v").distinct(), "links")
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state = seen
    leaves = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

"""Connected components of a graph that is a table of edges: alternating stars (Kiveris et al., SoCC 2014) as joins and aggregations.

Each round points every node's larger neighbours to the least node around it, and then its smaller ones likewise. No neighbourhood is
ever gathered; a hub is a skewed join, which Spark splits. Rounds grow with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.sources import tables


def _pointed(directed: DataFrame) -> DataFrame:
    """(u, v, low): the edges with the least of u and all its v."""
    low = directed.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    return directed.join(low, "u")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node of edges: root is the least node of its component."""
    stars = tables.settled(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct())
    nodes = edges.select(F.col(a).alias("node")).union(edges.select(F.col(b))).distinct()
    before = None
    while True:
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _pointed(both).filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        small = _pointed(large)
        small = small.filter("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v")).union(small.select("u", F.col("low").alias("v"))).distinct()
        stars = tables.settled(small)
        now = stars.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            break
        before = now
    return nodes.join(stars.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))

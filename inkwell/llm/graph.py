"""Connected components of a distributed edge list by alternating large and small stars (Kiveris et al., SoCC 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm import common


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v), u > v. Large: larger neighbours of u go to its smallest neighbour; small: u and its smaller neighbours do.

    The minima are written first: then both sides of the join are plain exchanges, and Spark can split a hub.
    """
    around = edges.union(edges.select(F.col("v"), F.col("u"))) if large else edges
    least = around.groupBy("u").agg(F.min("v").alias("m"))
    least = common.materialize(least.select("u", F.least("u", "m").alias("m")), "graph-minima")
    met = around.join(least.hint("merge"), "u")
    out = met.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if large else met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def _done(edges: DataFrame) -> bool:
    """Whether every edge (u, v) leads to a root: each u has one v, and no v is a u."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into")).filter("out > 1 or out = 1 and into = 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): the smallest node that it is linked with. Loops and repeated edges do no harm."""
    now = common.materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "graph-edges")
    while not _done(now):
        now = common.materialize(_star(common.materialize(_star(now, True), "graph-large"), False), "graph-small")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v"), F.col("v")).distinct())

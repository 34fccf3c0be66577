"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axonspark.llm.scratch import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the smallest node of its component.

    Alternates large-star and small-star steps until the edges are stars around
    their roots; each step is a map-side combined minimum and an equi-join whose
    other side has one row a node, so a node with a third of all edges is split
    by AQE. Nothing of the edges reaches the driver. Self loops and
    repeated edges are ignored; an empty table gives an empty result.
    """
    now = scratch.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _stars(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = scratch.keep(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "low")
        large = scratch.keep(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        low2 = scratch.keep(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        small = large.join(low2, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low2.select("a", F.col("m").alias("b")))
        made = scratch.keep(small.distinct(), "small")
        scratch.drop(now, low, large, low2)
        now = made
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _stars(edges: DataFrame) -> bool:
    """True if every edge runs from a node of no other edge to a root."""
    ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("leaf"), F.lit(0).alias("root")).unionByName(edges.select(F.col("b").alias("x"), F.lit(0).alias("leaf"), F.lit(1).alias("root")))
    return ends.groupBy("x").agg(F.sum("leaf").alias("leaf"), F.max("root").alias("root")).where("leaf > 1 or (leaf > 0 and root > 0)").isEmpty()

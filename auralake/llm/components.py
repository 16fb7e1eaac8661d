"""Connected components of a table of links, without bringing links or components to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, spill


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b): component is the least node that links reach.

    Alternating large-star and small-star steps until the links are stars around the least nodes. Each step is
    a minimum by node, which aggregates before its shuffle, and a join back, whose hot nodes Spark can split.
    """
    edges = spill(_below(links.select("a", "b")), "links")
    state = None
    while True:
        # Large star: every node sends its greater neighbours to the least node it sees.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = _below(large)
        # Small star: every node sends its lesser neighbours, and itself, to the least of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        before, edges = edges, spill(_below(small), "links")
        discard(before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == state:
            break
        state = now
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = stars.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
    found._spilled = edges._spilled  # for discard()
    return found


def _below(edges: DataFrame) -> DataFrame:
    """Each link once, from its greater to its lesser node."""
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

"""Connected components of an edge table by alternating large and small stars.

Each step is a minimum by node and a join on the node: no neighbourhood is ever collected into one row, the
minimum is combined before the shuffle, and a hub's edges can be split by adaptive execution,
since both join sides are plain shuffles of stored tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash


def _stars(edges: DataFrame) -> bool:
    """Whether every edge (a, b) runs from a node that is never b to one that is b once and never a: then a is the component of b."""
    ends = edges.select(F.col("a").alias("n"), F.lit(1).alias("top"), F.lit(0).alias("below")).unionByName(edges.select(F.col("b").alias("n"), F.lit(0).alias("top"), F.lit(1).alias("below")))
    seen = ends.groupBy("n").agg(F.max("top").alias("top"), F.sum("below").alias("below"))
    return seen.where("below > 1 or (top = 1 and below = 1)").isEmpty()


def connected_components(links: DataFrame) -> DataFrame:
    """links: columns a, b of one ordered type, in any order and with repeats; nulls and loops are ignored.
    Returns node, component (the smallest node reachable), a row for each node that has a link."""
    edges = stash(links.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    while not _stars(edges):
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = stash(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "low")
        large = stash(both.where("v > u").join(low, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct(), "edges")
        low = stash(large.groupBy("b").agg(F.min("a").alias("m")), "low")
        small = large.join(low, "b")
        small = small.select(F.col("m").alias("a"), "b").unionByName(small.where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b")))
        edges = stash(small.distinct(), "edges")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())

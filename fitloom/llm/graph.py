"""Connected components of an edge table, by alternating stars.

Each round points every node's larger neighbours to its least neighbour (large star), then each node's smaller neighbours
to the least of them (small star), until every edge leads to a root. The number of rounds grows with the logarithm of a
component's size. Rounds are written to shared storage, so lineage stays short; a hot node's edges are split by the
adaptive skew join, its minimum is aggregated in parts first.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitloom.plans.scratch import Scratch


def components(edges: DataFrame) -> DataFrame:
    """node and component (the least node reachable) for every node of ``edges`` (a, b); nulls and loops are ignored."""
    scratch = Scratch(edges.sparkSession, "components")
    least, most = F.least("a", "b"), F.greatest("a", "b")
    stars = scratch.keep(edges.filter("a <> b").select(most.alias("u"), least.alias("v")).distinct(), "0")
    for i in itertools.count(1):
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = scratch.keep(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), str(i))
        # Done when each node has one root, and no root is below another.
        roots = stars.select(F.col("v").alias("u")).distinct()
        n, nodes = stars.agg(F.count("*"), F.count_distinct("u")).first()
        scratch.drop(str(i - 1))
        if n == nodes and stars.join(roots, "u", "left_semi").isEmpty():
            break
    members = stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

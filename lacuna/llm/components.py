"""Connected components of an edge table by alternating large and small stars.

Every step is a grouped minimum and one join.  The minima are settled first, so
both sides of the join are plain exchanges and the adaptive skew join can split
a node with a large share of all edges.  Edges stay in the cluster; each round
is written to the shared folder and the one before it deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Settled


def connect(edges: DataFrame) -> DataFrame:
    """(a, b) long ids -> (node, component), for nodes that aren't the smallest of theirs."""
    pairs = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    now = Settled(pairs)
    while not is_star(now.df):
        both = now.df.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.df.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = Settled(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = Settled(both.where("v > u").join(least.df, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct())
        lower = Settled(large.df.groupBy("b").agg(F.min("a").alias("m")))
        moved = large.df.join(lower.df, "b").where("m < a").select(F.col("m").alias("a"), F.col("a").alias("b"))
        after = Settled(moved.unionByName(lower.df.select(F.col("m").alias("a"), "b")).distinct())
        for done in (now, least, large, lower):
            done.drop()
        now = after
    return now.df.select(F.col("b").alias("node"), F.col("a").alias("component"))


def is_star(edges: DataFrame) -> bool:
    """No node has two centres or is both a centre and a leaf."""
    ends = edges.select(F.col("b").alias("n"), F.lit(1).alias("leaf"), F.lit(0).alias("centre")).unionByName(edges.select(F.col("a").alias("n"), F.lit(0).alias("leaf"), F.lit(1).alias("centre")))
    return ends.groupBy("n").agg(F.sum("leaf").alias("leaves"), F.max("centre").alias("centre")).where("leaves > 1 or (leaves = 1 and centre = 1)").isEmpty()


def members_of(edges: DataFrame, into: str) -> DataFrame:
    """(node, ``into``) for every node of an edge, its component's smallest one included."""
    found = connect(edges).withColumnRenamed("component", into)
    return found.unionByName(found.select(F.col(into).alias("node"), into).distinct())

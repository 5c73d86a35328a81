"""Connected components by alternating large and small stars, on tables in the shared folder.

A step costs two groupings by node and never gathers the neighbours of a node: a node passes its least
neighbour on to each edge by a join. The number of steps grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardloom.llm.common import forget, stored, stored_alone


def _starred(edges: DataFrame) -> bool:
    """Has every node one edge to a less one, or only edges from greater ones."""
    ends = F.array(F.struct(F.col("hi").alias("u"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("lo").alias("u"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = edges.select(F.inline(ends)).groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.where("up + down > 1").isEmpty()


def _shorter(now: DataFrame) -> DataFrame:
    """Edges of one step: a large star and a small one."""
    both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "star")
    large = stored(now.join(least.withColumnRenamed("u", "lo"), "lo").select("hi", F.col("m").alias("lo")), "large")
    # an edge's smaller end sends the larger one to the least that it knows; the larger end then joins all of its smaller ones
    root = stored(large.groupBy("hi").agg(F.min("lo").alias("m")), "star")
    small = large.join(root, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return small.unionByName(root.withColumnRenamed("m", "lo")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, label (the least node of its component) for the ends of all edges (a, b)."""
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges")
    while not _starred(now):
        before, now = now, stored_alone(lambda: _shorter(now), "edges")
        forget(before)
    stars = now.select(F.col("hi").alias("node"), F.col("lo").alias("label"))
    found = stored(stars.unionByName(stars.select(F.col("label").alias("node"), "label").distinct()), "classes")
    forget(now)
    return found

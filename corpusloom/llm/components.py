"""Connected components of links between nodes, by alternating large and small stars.

Each step is a grouped minimum, combined before its shuffle, and a join; no neighbourhood is
ever gathered in one row, and neither links nor components reach the driver. A node with very many
links meets them as rows of two short values, which adaptive execution splits where one partition
outgrows the others.

Defined results: links of a node to itself and repeated links count for nothing, and neither do links
with a null end; a node without links is in no component; no links give an empty result; further columns are
not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import removed, written


def _least(edges: DataFrame) -> DataFrame:
    """Of each u: the least of itself and its neighbours."""
    return edges.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("least"))


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    joined = both.join(_least(both), "u").where(F.col("v") > F.col("u"))
    return joined.select(F.col("v").alias("u"), F.col("least").alias("v")).where("u != v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    joined = down.join(least, "u").where(F.col("v") != F.col("least")).select(F.col("v").alias("u"), F.col("least").alias("v"))
    return joined.unionByName(least.select("u", F.col("least").alias("v"))).where("u != v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of ``links`` (u, v): the least node of its component."""
    edges = written(links.select("u", "v").where("u != v").distinct(), "edges")  # also drops null ends
    state = None
    while True:
        before, edges = edges, written(_small(_large(edges)), "edges")
        removed(before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())

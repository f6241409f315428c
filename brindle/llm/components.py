"""Connected components by alternating large-star and small-star steps over a table of links.

Each step keeps at most one row a link, whatever a node's degree, and is written to the shared folder, so that
neither a hub nor the number of rounds grows the lineage. Hubs meet their least neighbour where their links are
(`hot_join`), so none is one task's work. A step has as many tasks as its links need (`tasks_for`), not as many as the
session's shuffles have partitions, since its shuffles are many and their rows are narrow. Rounds are bounded by the square of the logarithm of the number of nodes; in
practice they grow with the logarithm of the longest chain.

Defined results: links with a null end, loops and repeated links count for nothing; nodes without a link are not in the
result; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_join, staged, tasks_for, unstage


def _large_star(links: DataFrame, total: int) -> DataFrame:
    """Links (hi, lo), hi > lo: every larger neighbour of u is tied to the least of u and its neighbours."""
    both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(links.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return hot_join(both.where("v > u"), least, "u", "n", 2 * total, tasks_for(2 * total)).select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct().coalesce(tasks_for(total))


def _small_star(links: DataFrame, total: int) -> DataFrame:
    """Every smaller neighbour of u, and u itself, is tied to the least of them."""
    least = links.groupBy("hi").agg(F.min("lo").alias("m"), F.count(F.lit(1)).alias("n"))
    moved = hot_join(links, least, "hi", "n", total, tasks_for(total)).where("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.union(least.select("hi", F.col("m").alias("lo")).coalesce(tasks_for(total))).distinct().coalesce(tasks_for(total))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the least node that it reaches) for each node with a link."""
    at = staged(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct(), "links")
    mark = None
    while True:
        sums = at.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if tuple(sums) == mark or not sums[0]:
            break
        mark = tuple(sums)
        large = staged(_large_star(at, sums[0]), "links")
        step = staged(_small_star(large, sums[0]), "links")
        unstage(at, large)
        at = step
    stars = at.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return stars.union(at.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())

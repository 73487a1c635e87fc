"""Connected components of a table of links, by alternating stars.

In a large-star step every node hands its larger neighbours to its smallest one, in a small-star step its smaller ones.
Both are a minimum per node, combined before the shuffle, and a join, so that a node with a third of all links is no
special case. The links of every round are written to the shared folder; rounds end when a round changes nothing, after
a number that grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumipair.shared import written


def _star(links: DataFrame) -> DataFrame:
    """Connect the far ends of the links (u, v) of every u to the smallest node among u and them."""
    smallest = links.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return links.join(smallest, "u")


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _star(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    stars = _star(down)
    handed = stars.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return handed.unionByName(stars.select("u", F.col("m").alias("v"))).distinct()


def _sum(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38, 0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (u, v), both long; the root is the smallest node of the component.

    Loops and repeated links do no harm; a root is listed with itself.
    """
    links = written(links.filter("u <> v").distinct(), "links")
    before = _sum(links)
    while before[0]:
        links = written(_small_star(_large_star(links)), "links")
        after = _sum(links)
        if after == before:
            break
        before = after
    leaves = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return leaves.unionByName(leaves.select(F.col("root").alias("node"), "root").distinct())

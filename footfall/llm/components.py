"""Connected components over a table of links, by alternating large and small stars
(Kiveris et al., 2014). Each round is written to the shared folder, so a lost executor
costs one round; a hub of many links is only ever aggregated or joined, never gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.session import drop_stage, stage


def _large_star(links: DataFrame) -> DataFrame:
    """Point every larger neighbour of a node to the node's smallest neighbour."""
    both = links.select("u", "v").union(links.select("v", "u"))
    low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("low"))
    moved = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return moved.distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Point a node and its smaller neighbours to the smallest of them."""
    low = links.groupBy("u").agg(F.min("v").alias("low"))
    moved = links.join(low, "u")
    others = moved.filter("v != low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return others.union(low.select("u", F.col("low").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """Smallest node reachable from each linked node that is not itself the smallest: ``node, root``.

    ``links`` holds pairs ``a, b``; nulls and loops are ignored. Rounds grow with the
    logarithm of the number of nodes; they end when a round changes nothing.
    """
    links = links.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    links, last = stage(links, "links"), None
    while True:
        state = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        last, before = state, links
        links = stage(_small_star(_large_star(links)), "links")
        drop_stage(before)

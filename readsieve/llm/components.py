"""Connected components over a distributed table of links.

Alternating large-star and small-star steps: each node hands its larger (then its smaller)
neighbours to the smallest one it knows.  A step is an aggregate, which combines before the
shuffle, and an equi-join, whose hot keys adaptive execution splits; no neighbour list is ever
built.  Every step is written to the shared folder, so a lost executor costs one step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import Workspace


def _large_star(links: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the smallest of itself and its neighbours."""
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("m").alias("u"), "v").where("u <> v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every node links itself and its smaller neighbours to the smallest of these. Here u < v."""
    least = links.groupBy("v").agg(F.min("u").alias("m"))
    handed = links.join(least, "v").where("u <> m").select(F.col("m").alias("u"), F.col("u").alias("v"))
    return handed.union(least.select(F.col("m").alias("u"), "v")).distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(links: DataFrame, work: Workspace) -> DataFrame:
    """(node, component): each node of a link, with the smallest node that it reaches.

    ``links``: columns u < v, long, without nulls; repeated links do no harm.
    """
    links = work.save(links.select("u", "v").where("u < v"))
    before = _state(links)
    while before[0]:
        after = work.save(_small_star(_large_star(links)))
        work.drop(links)
        links, now = after, _state(after)
        if now == before:
            break
        before = now
    nodes = links.select(F.col("v").alias("node"), F.col("u").alias("component"))
    return nodes.union(links.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())

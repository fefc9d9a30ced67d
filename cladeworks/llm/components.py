"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeworks.session import settle

#: Links of a node from which on they are joined where they lie, with the node's row broadcast: at most one such node for so many links.
HUB = 100_000


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def _with(links: DataFrame, least: DataFrame) -> DataFrame:
    """``links`` (u, v) with m of their u. Hubs' links are not dealt by u, so no task gets all links of a node."""
    hubs = least.where(F.col("n") >= HUB).select("u", "m")
    if hubs.isEmpty():
        return links.join(least.select("u", "m"), "u")
    rest = links.join(F.broadcast(hubs), "u", "left_anti").join(least.select("u", "m"), "u")
    return links.join(F.broadcast(hubs), "u").unionByName(rest)


def components(links: DataFrame) -> DataFrame:
    """node, root for every node of ``links`` (u, v: long): root is the smallest node that can be reached.

    Nulls and links of a node to itself are passed over; repeated links count once; an empty table gives none. Each
    step needs only the smallest of a node's neighbours, which is aggregated before rows are shuffled, and links it
    to each other one; the links of a node with very many stay where they are. Steps are written out, which cuts the
    lineage.
    """
    ends = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = settle(ends, "links")
    state = _state(now)
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = settle(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n")), "stars")
        large = _with(both, least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = settle(large, "links")
        least = settle(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "stars")
        small = _with(large, least).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(least.select("u", F.col("m").alias("v"))).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        now = settle(small.distinct(), "links")
        before, state = state, _state(now)
        if state == before:
            break
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select("node", F.col("node").alias("root")))

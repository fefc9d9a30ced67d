"""Connected components of links between numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeworks.session import settle


def components(links: DataFrame) -> DataFrame:
    """node, root: of each node of ``links`` (u, v: long) the smallest one that links lead to.

    Each round, a node's label becomes the smallest among its neighbours' labels and the label of its label, so that
    labels jump; the ends of links move to their labels, and links within one label are dropped. The number of links
    only falls, and rounds are about as many as the logarithm of the longest way.
    """
    links = settle(links.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "links")
    labels = settle(links.select(F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("root", F.col("node")), "labels")
    while not links.isEmpty():
        ends = links.union(links.select("v", "u")).toDF("node", "other")
        least = settle(ends.groupBy("node").agg(F.least("node", F.min("other")).alias("to")), "least")
        while True:  # follow the smaller neighbours to their ends
            jump = least.join(least.toDF("to", "next"), "to", "left").select("node", F.coalesce("next", "to").alias("next"), "to")
            jump = settle(jump, "jumps")
            least = jump.select("node", F.col("next").alias("to"))
            if jump.where("next <> to").isEmpty():
                break
        labels = settle(labels.join(least.toDF("root", "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root")), "labels")
        moved = links.join(least.toDF("u", "a"), "u").join(least.toDF("v", "b"), "v").where("a <> b")
        links = settle(moved.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "links")
    return labels

"""Compare trees in files: whether two are one topology, distances of trees, how much a collection disagrees.

    spark-submit --py-files cladeworks.zip cladeworks/jobs/evaluate.py same one.tre other.tre
    spark-submit --py-files cladeworks.zip cladeworks/jobs/evaluate.py distances true.tre one.tre other.tre
    spark-submit --py-files cladeworks.zip cladeworks/jobs/evaluate.py dataset gene_trees.tre species.tre --max-trees 5

Of a file of ``same`` and ``distances`` the first line that is not blank counts. A row of results is printed, or, with
--output, all are written as a CSV folder.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeworks.functions import bits
from cladeworks.jobs.reports import dataset_discordance
from cladeworks.jobs.trees import Collection
from cladeworks.operators import compare
from cladeworks.session import settle, temporary
from cladeworks.sources import newick


def first_trees(spark: SparkSession, files: list[str]) -> Collection:
    """The first line of each file, numbered like the files; one that can't be read is an error."""
    lines = [newick.read_lines(spark, f, 1).select(F.lit(i).cast("long").alias("tree_id"), "newick") for i, f in enumerate(files)]
    trees = Collection(settle(_all(lines), "lines"))
    ok = {r.tree_id for r in trees.status.where("status = 'ok'").collect()}
    if bad := [f for i, f in enumerate(files) if i not in ok]:
        raise ValueError(f"no tree could be read from {', '.join(bad)}")
    return trees


def _all(tables: list[DataFrame]) -> DataFrame:
    one, *more = tables
    for other in more:
        one = one.unionByName(other)
    return one


def same(spark: SparkSession, one: str, other: str) -> DataFrame:
    """same: whether the rooted trees of two files have the same clusters of the same taxa."""
    trees = first_trees(spark, [one, other])
    clusters = trees.nodes.select("tree_id", bits.union("left", "right", trees.words).alias("u"))
    leaves = trees.order.groupBy("taxon").agg(F.count("*").alias("n")).agg(F.bool_and(F.col("n") == 2).alias("taxa"))
    found = compare.same_topology(clusters, trees.order, clusters.where("tree_id = 0")).where("tree_id = 1")
    return found.crossJoin(leaves).select((F.col("same") & F.col("taxa")).alias("same"))


def distances(spark: SparkSession, files: list[str]) -> DataFrame:
    """tree_1, tree_2 (files), distance, rf (normed to 0 to 1), similarity_pct of each two files, the nearest first."""
    trees = first_trees(spark, files)
    found = compare.all_pairs(compare.unrooted(trees.nodes, trees.words), trees.order)
    rf = compare.normed(F.col("distance"), trees.n_taxa)
    name = lambda c: F.element_at(F.array(*map(F.lit, files)), (F.col(c) + 1).cast("int")).alias(c)
    return found.select(name("tree_1"), name("tree_2"), "distance", F.round(rf, 4).alias("rf"), F.round((1 - rf) * 100, 1).alias("similarity_pct")).orderBy("rf", "tree_1", "tree_2")


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description="Compare trees in files of Newick lines.")
    kinds = parser.add_subparsers(dest="kind", required=True)
    two = kinds.add_parser("same", help="whether two trees have one topology")
    two.add_argument("one")
    two.add_argument("other")
    several = kinds.add_parser("distances", help="distances of each two trees")
    several.add_argument("files", nargs="+")
    data = kinds.add_parser("dataset", help="how much gene trees differ from each other and from a species tree")
    data.add_argument("genes")
    data.add_argument("species")
    data.add_argument("--max-trees", type=int, default=5, help="lines of gene trees that are compared")
    for p in (two, several, data):
        p.add_argument("--output", help="folder for the results as CSV")
    found = parser.parse_args(args)
    if found.kind == "distances" and len(found.files) < 2:
        parser.error("distances need two files or more")
    spark = SparkSession.builder.appName("evaluate-trees").getOrCreate()
    with temporary(spark):
        if found.kind == "same":
            rows = same(spark, found.one, found.other)
        elif found.kind == "distances":
            rows = distances(spark, found.files)
        else:
            rows = dataset_discordance(newick.read_lines(spark, found.genes), newick.read_lines(spark, found.species), found.max_trees)
        if found.output:
            rows.coalesce(1).write.option("header", True).csv(found.output)
            return 0
        for row in rows.toLocalIterator():  # a row for each two files
            print(", ".join(f"{k}={v}" for k, v in row.asDict().items()))
            if found.kind == "same":
                return 0 if row.same else 1
    return 0


if __name__ == "__main__":
    sys.exit(main())

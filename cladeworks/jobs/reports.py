"""Reports about collections of trees: how much they disagree, and the record of an inference run."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeworks.jobs.trees import Collection, Options, infer_species_tree
from cladeworks.operators import compare
from cladeworks.session import settle


def discordance(edges: DataFrame, trees: DataFrame, species: DataFrame, n_taxa: int) -> DataFrame:
    """One row: mean normed distances of pairs of trees (tree_id) and of trees to one (s), with their numbers; 0 where there are none."""
    nrf = compare.normed(F.col("distance"), n_taxa)
    mean = lambda df, k: df.agg(F.coalesce(F.avg(nrf), F.lit(0.0)).alias(k), F.count("*").alias(f"n_{k}"))
    row = mean(compare.all_pairs(edges, trees), "g").crossJoin(mean(compare.to_one(edges, trees, species), "s"))
    g, s = F.col("g"), F.col("s")
    return row.select(
        F.round(g, 6).alias("gene_gene"), F.col("n_g").alias("n_pairs"), F.round((1 - g) * 100, 4).alias("similarity_pct"), compare.nearness(g).alias("pairs_are"),
        F.round(s, 6).alias("gene_species"), F.col("n_s").alias("n_trees"), compare.nearness(s).alias("trees_are"),
    )


def dataset_discordance(genes: DataFrame, species: DataFrame, max_gt: int = 5) -> DataFrame:
    """Disagreement of the first ``max_gt`` lines (tree_id, newick) with each other and with the species tree, a line likewise.

    The lines are taken by tree_id before any is checked; those that can't be read are passed over. Trees share one
    dictionary, whose size norms the distances.
    """
    if max_gt < 1:
        raise ValueError("max_gt must be at least 1")
    first = genes.orderBy("tree_id").limit(max_gt).select(F.col("tree_id").cast("long").alias("tree_id"), "newick")
    own = (first.agg(F.min("tree_id")).first()[0] or 0) - 1
    one = species.orderBy("tree_id").limit(1).select(F.lit(own).cast("long").alias("tree_id"), "newick")
    trees = Collection(settle(first.unionByName(one), "lines"))
    if trees.status.where((F.col("tree_id") == own) & (F.col("status") == "ok")).isEmpty():
        raise ValueError("the species tree can't be read")
    edges = settle(compare.unrooted(trees.nodes, trees.words), "edges")
    mine = trees.nodes.where(F.col("tree_id") != own)
    return discordance(edges.where(F.col("tree_id") != own), mine, edges.where(F.col("tree_id") == own), trees.n_taxa)


def benchmark_record(spark: SparkSession, genes: DataFrame, truth: DataFrame, replicate: str, sb: str = "NA", spmin: str = "NA", spmax: str = "NA", options: Options = Options()) -> tuple[DataFrame, DataFrame]:
    """The inferred tree, and one row of the benchmark's columns for it: an inference run, its time and its distance to the true tree.

    Memory is not sampled here (NA): Spark's own metrics have it.
    """
    began = time.perf_counter()
    found = settle(infer_species_tree(genes, options), "inferred")
    took = time.perf_counter() - began
    lines = found.select(F.lit(0).cast("long").alias("tree_id"), "newick").unionByName(truth.orderBy("tree_id").limit(1).select(F.lit(1).cast("long").alias("tree_id"), "newick"))
    trees = Collection(lines)
    far = compare.all_pairs(compare.unrooted(trees.nodes, trees.words), trees.nodes).select(F.round(compare.normed(F.col("distance"), trees.n_taxa), 6).alias("rf"))
    n = found.select("n_trees")
    values = {"alg": F.lit("triplets"), "num-taxa": F.lit(trees.n_taxa), "gene-trees": F.col("n_trees"), "replicate": F.lit(replicate), "sb": F.lit(sb), "spmin": F.lit(spmin), "spmax": F.lit(spmax), "rf-rate": F.col("rf"), "running-time-s": F.lit(round(took, 3)), "max-cpu-mb": F.lit("NA"), "max-gpu-mb": F.lit("NA")}
    return found, n.join(F.broadcast(far), F.lit(True), "left").select(*(v.alias(k) for k, v in values.items()))

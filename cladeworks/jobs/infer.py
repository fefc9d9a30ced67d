"""Infer a species tree from a file of gene trees.

    zip -r cladeworks.zip cladeworks
    spark-submit --py-files cladeworks.zip --conf spark.checkpoint.dir=hdfs:///shared/work \
        cladeworks/jobs/infer.py gene_trees.tre species_tree --support posterior --report report

The result is a folder with one line of Newick text. Workers import the package, so it must be given by --py-files (or
installed on all nodes); the checkpoint folder must be one that all executors share. How many lines were left out, and
why, is told on standard error; a report has the lines themselves (skipped), their counts (status) and a record of the
run (run), as CSV folders.
"""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeworks.jobs.trees import Collection, Options, species_tree
from cladeworks.session import settle, temporary
from cladeworks.sources import newick, stats


def skipped(trees: Collection) -> DataFrame:
    """tree_id, status, newick of the lines that were left out; blank lines are not lines."""
    return trees.lines.join(trees.status.where("status <> 'ok'").select("tree_id", "status"), "tree_id").select("tree_id", "status", "newick")


def run_record(source: str, out: str, seconds: float) -> dict:
    """The columns of a run's record; memory is not sampled here (NA), since Spark's own metrics have it."""
    values = ("triplets", source, out, f"{seconds:.3f}", "NA", "NA", "0")
    return {c: F.lit(v).alias(c) for c, v in zip(stats.RUN, values, strict=True)}


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Infer a species tree from gene trees, one Newick line each.")
    parser.add_argument("input")
    parser.add_argument("output")
    parser.add_argument("--support", choices=("posterior", "length", "both", "pvalue", "detailed", "all"))
    parser.add_argument("--lambda", dest="lam", type=float, default=0.5)
    parser.add_argument("--internal-labels", choices=("ignore", "reject"), default="ignore")
    parser.add_argument("--keep", action="store_true", help="leave a result that is there")
    parser.add_argument("--report", help="folder for the lines left out, their counts and the record of the run")
    parser.add_argument("--verify", action="store_true", help="compare sets that are known by hashes leaf by leaf")
    found = parser.parse_args(args)
    spark = SparkSession.builder.appName("infer-species-tree").getOrCreate()
    options, began = Options(internal_labels=found.internal_labels, support=found.support, lam=found.lam), time.perf_counter()
    with temporary(spark):
        trees = Collection(settle(newick.read_lines(spark, found.input), "lines"), options)
        counts = {r.status: r.n for r in trees.status.groupBy("status").agg(F.count("*").alias("n")).collect()}
        if bad := {k: v for k, v in sorted(counts.items()) if k != "ok"}:
            print(f"left out {sum(bad.values())} of {sum(counts.values())} lines: {', '.join(f'{v} {k}' for k, v in bad.items())}", file=sys.stderr)
        if found.report:
            skipped(trees).write.mode("overwrite").option("header", True).csv(f"{found.report}/skipped")
            trees.status.groupBy("status").agg(F.count("*").alias("n_lines")).coalesce(1).write.mode("overwrite").option("header", True).csv(f"{found.report}/status")
        if found.verify and not trees.collisions.isEmpty():
            raise ValueError("two sets of taxa have one hash")
        newick.write_newick(species_tree(trees), found.output, "ignore" if found.keep else "error")
        if found.report:
            row = spark.range(1).select(*run_record(found.input, found.output, time.perf_counter() - began).values())
            stats.write(row, f"{found.report}/run", stats.RUN, "append")


if __name__ == "__main__":
    main()

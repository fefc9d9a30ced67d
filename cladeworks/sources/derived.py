"""Gene trees derived from orders and customers: nations ranked by their largest order, a tree for each group of orders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LEVELS = 5


def gene_leaves(spark: SparkSession, sf_dir: str, taxa: str = "nation", monthly: bool = False) -> DataFrame:
    """tree_id, taxon, pos: taxa are nations or regions; a tree for each year (or month) and priority of orders."""
    orders, customer = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer"))
    day = F.col("o_orderdate")
    period = F.year(day) * 100 + F.month(day) if monthly else F.year(day)
    tree = (period * 10 + F.substring("o_orderpriority", 1, 1).cast("int")).cast("int").alias("tree_id")
    cells = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(tree, F.col("c_nationkey").alias("taxon")).agg(F.max("o_totalprice").alias("m"))
    if taxa == "region":
        nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("taxon"), "n_regionkey")
        cells = cells.join(F.broadcast(nation), "taxon").groupBy("tree_id", F.col("n_regionkey").alias("taxon")).agg(F.max("m").alias("m"))
    rank = F.row_number().over(Window.partitionBy("tree_id").orderBy(F.desc("m"), "taxon")) - 1
    return cells.select("tree_id", "taxon", rank.cast("long").alias("pos"))


def part_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tree_id, taxon, pos: a tree for each part, its taxa the nations of its suppliers, by their largest price. Trees are as many as parts."""
    lineitem, supplier = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "supplier"))
    cells = lineitem.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("l_partkey").alias("tree_id"), F.col("s_nationkey").alias("taxon")).agg(F.max("l_extendedprice").alias("m"))
    rank = F.row_number().over(Window.partitionBy("tree_id").orderBy(F.desc("m"), "taxon")) - 1
    return cells.select("tree_id", "taxon", rank.cast("long").alias("pos"))


def supplier_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tree_id, taxon, pos: a tree for each month of shipping, its taxa the suppliers, by their largest price. Taxa are as many as suppliers."""
    month = (F.year("l_shipdate") * 100 + F.month("l_shipdate")).cast("int").alias("tree_id")
    cells = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(month, F.col("l_suppkey").alias("taxon")).agg(F.max("l_extendedprice").alias("m"))
    rank = F.row_number().over(Window.partitionBy("tree_id").orderBy(F.desc("m"), "taxon")) - 1
    return cells.select("tree_id", "taxon", rank.cast("long").alias("pos"))


def label(taxon: Column) -> Column:
    """The label of a taxon: T and at least two digits."""
    digits = taxon.cast("string")
    return F.concat(F.lit("T"), F.when(F.length(digits) < 2, F.lpad(digits, 2, "0")).otherwise(digits))


def newick(leaves: DataFrame, shape: str = "dyadic", levels: int = LEVELS) -> DataFrame:
    """tree_id, newick for ordered leaves: 'dyadic' halves the positions at each of so many levels, 'caterpillar' takes off one leaf at a time."""
    named = leaves.select("tree_id", "pos", label(F.col("taxon")).alias("s"))
    if shape == "caterpillar":
        order = F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda x: x["s"])
        rows = named.groupBy("tree_id").agg(order.alias("x"))
        nest = F.aggregate(F.slice(F.reverse("x"), 2, F.size("x")), F.element_at("x", -1), lambda a, s: F.concat(F.lit("("), s, F.lit(","), a, F.lit(")")))
        return rows.select("tree_id", F.concat(nest, F.lit(";")).alias("newick"))
    for _ in range(levels):
        pair = F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda x: x["s"])
        both = named.groupBy("tree_id", F.shiftright("pos", 1).alias("pos")).agg(pair.alias("x"))
        named = both.select("tree_id", "pos", F.when(F.size("x") == 2, F.concat(F.lit("("), F.array_join("x", ","), F.lit(")"))).otherwise(F.element_at("x", 1)).alias("s"))
    return named.select("tree_id", F.concat("s", F.lit(";")).alias("newick"))


def with_faults(trees: DataFrame) -> DataFrame:
    """The trees again, with faults that depend on tree_id: for tests of what readers pass over and count."""
    t, k = F.col("newick"), F.pmod("tree_id", F.lit(9))
    faults = [
        (1, F.regexp_replace(t, r"\(", "")),
        (2, F.regexp_replace(t, r"\)", "")),
        (3, F.concat(t, t)),
        (4, F.concat(F.lit("[&R] "), F.regexp_replace(t, ",", ":0.5,"))),
        (5, F.regexp_replace(t, r"\)", ")0.9")),
        (6, F.regexp_replace(t, "T[0-9]+", "T1")),
        (7, F.concat(F.lit("("), F.regexp_replace(t, ";", ");"))),
        (8, F.lit("  ")),
    ]
    return trees.select("tree_id", reduce(lambda c, f: c.when(k == f[0], f[1]), faults[1:], F.when(k == faults[0][0], faults[0][1])).otherwise(t).alias("newick"))

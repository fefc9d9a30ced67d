"""Gene trees of the driver tables, parsed once for a job, and the job that infers a species tree."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeworks.functions import bits, support
from cladeworks.operators import dp, quartets, splits, weights
from cladeworks.session import settle
from cladeworks.sources import derived, newick


#: With more taxa, sets are known by hashes. A split's weight is computed from sets, or, if the sets' words are that many
#: times those of the trees' leaf orders, along these orders.
MASKED, WORDS_AN_ORDER = 630, 16


@dataclass(frozen=True)
class Options:
    """How lines are read and branches annotated; ``support`` of None leaves branches plain."""

    internal_labels: str = "ignore"
    support: str | None = None
    lam: float = 0.5
    expansion: str = "NONE"

    def __post_init__(self):
        if self.internal_labels not in ("ignore", "reject"):
            raise ValueError(f"internal_labels: {self.internal_labels}")
        if self.support not in (None, "posterior", "length", "both", "pvalue", "detailed", "all"):
            raise ValueError(f"support: {self.support}")
        if self.expansion.upper() != "NONE":
            raise ValueError("candidates are not expanded")


class Collection:
    """A collection of gene trees: each stage is computed once, when it is first asked for."""

    def __init__(self, lines: DataFrame, options: Options = Options(), taxa: DataFrame | None = None):
        self.lines, self.options, self._taxa = lines, options, taxa

    @cached_property
    def _parsed(self) -> newick.Parsed:
        return newick.parse(self.lines, self.options.internal_labels, self._taxa)

    @cached_property
    def trees(self) -> DataFrame:
        """tree_id, labels, start, mid, end: accepted trees as arrays."""
        return settle(self._parsed.trees, "trees")

    @cached_property
    def status(self) -> DataFrame:
        return settle(self._parsed.status, "status")

    @cached_property
    def leaves(self) -> DataFrame:
        return newick.leaves(self.trees)

    @cached_property
    def taxa(self) -> DataFrame:
        return self._taxa or settle(splits.dictionary(self.leaves), "taxa")

    @cached_property
    def n_taxa(self) -> int:
        found = self.taxa.agg(F.max("taxon")).first()[0]
        if found is None:
            raise ValueError("no tree could be read")
        return found + 1

    @cached_property
    def words(self) -> int:
        """Words of a set, or HASHED."""
        return bits.words(self.n_taxa) if self.n_taxa <= MASKED else bits.HASHED

    @cached_property
    def order(self) -> DataFrame:
        return splits.leaf_order(self.leaves, self.taxa)

    @cached_property
    def nodes(self) -> DataFrame:
        return settle(splits.node_splits(self.trees, self.taxa, self.words), "nodes")

    @cached_property
    def splits(self) -> DataFrame:
        return settle(splits.frequencies(self.nodes), "splits")

    @cached_property
    def by_order(self) -> bool:
        """Whether weights are computed along leaf orders: with hashed sets, or if distinct splits are too many to meet each other."""
        trees = self.status.where("status = 'ok'").count()
        return self.words == bits.HASHED or self.splits.count() * self.words > WORDS_AN_ORDER * trees * self.n_taxa

    @cached_property
    def weights(self) -> DataFrame:
        if self.by_order:
            return settle(weights.weights_by_ranges(self.splits, self.arrays), "weights")
        return settle(weights.weights(self.splits, self.splits, self.words), "weights")

    @cached_property
    def root(self) -> DataFrame:
        return settle(splits.root_cluster(self.nodes, self.leaves, self.taxa, self.words), "root")

    @cached_property
    def solved(self) -> DataFrame:
        return settle(dp.solve(self.weights, self.root, self.words), "solved")

    @cached_property
    def leaf_sets(self) -> DataFrame:
        """mask, freq: distinct leaf sets of the trees."""
        whole = self.nodes.where("start = 0").groupBy("tree_id").agg(F.max_by(bits.union("left", "right", self.words), "end").alias("mask"))
        return whole.groupBy("mask").agg(F.count("*").alias("freq"))

    @cached_property
    def arrays(self) -> DataFrame:
        """tree_id, order, start, mid, end as arrays, a row for each tree that has a node."""
        return settle(weights.tree_arrays(self.order, self.nodes), "arrays")

    @cached_property
    def collisions(self) -> DataFrame:
        """tree_id, start, mid, end of the nodes whose split is hashed like another one, though its leaves differ; none with sets of members."""
        if self.words != bits.HASHED:
            return self.nodes.select("tree_id", "start", "mid", "end").limit(0)
        key = F.struct(F.least("left", "right").alias("a"), F.greatest("left", "right").alias("b"))
        found = splits.check_groups(self.nodes.select("tree_id", "start", "mid", "end", key.alias("key")), self.arrays, halves=True)
        return found.where("part > 0").select("tree_id", "start", "mid", "end")

    def branches(self, tree: DataFrame) -> DataFrame:
        """branch, f1, f2, f3, n, possible and the support of each inner branch of one tree (u, a, b).

        With sets of members these meet the splits; with hashed sets the tree is laid out by its leaves, and the gene trees
        are gone through along theirs.
        """
        if self.words == bits.HASHED:
            counts = self._branches_along(tree)
        else:
            every = self.taxa.agg(*(F.bit_or(w).alias(f"w{i}") for i, w in enumerate(bits.singleton(F.col("taxon"), self.words))))
            every = every.select(bits.key([F.col(f"w{i}") for i in range(self.words)]).alias("mask"))
            quads = quartets.quadripartitions(tree, every, self.words)
            counts = quartets.frequencies(quads, self.splits, self.leaf_sets, self.words)
        f, n, lam = [F.col(c) for c in ("f1", "f2", "f3")], F.col("n"), self.options.lam
        return counts.select("*", support.posterior(*f, n, lam).alias("posterior"), support.branch_length(f[0], n, lam).alias("length"), support.p_value(*f, n).alias("p_value"))

    def _branches_along(self, tree: DataFrame) -> DataFrame:
        rows = tree.select(F.lit(0).cast("long").alias("tree_id"), "u", "a", "b", F.lit(None).cast("string").alias("note"))
        own = Collection(dp.newick(rows, self.taxa, self.words), taxa=self.taxa)
        own.words = self.words
        counts = quartets.frequencies_along(own.nodes, own.order, self.taxa, self.arrays)
        branch = own.nodes.select(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), bits.union("left", "right", self.words).alias("branch"))
        return branch.join(counts, ["start", "end"]).drop("start", "end")


def infer_species_tree(lines: DataFrame, options: Options = Options()) -> DataFrame:
    """newick, score, n_trees, is_complete: the tree whose splits agree most with the triplets of (tree_id, newick) lines.

    Taxa are the labels of accepted trees. Unless the first largest tree has all of them (is_complete), the result
    lacks those that it lacks. With ``support``, inner branches are annotated from quartet frequencies, and have lengths.
    """
    return species_tree(Collection(lines, options))


def species_tree(trees: Collection) -> DataFrame:
    """As ``infer_species_tree``, of a collection, whose other stages can be looked at afterwards."""
    tree = trees.solved.where("in_tree").select(F.lit(0).alias("tree_id"), "u", "a", "b", "score")
    rows = tree.withColumn("note", F.lit(None).cast("string"))
    if kind := trees.options.support:
        found = trees.branches(tree.select("u", "a", "b")).where("n >= 1")
        note = support.annotation(kind, F.col("posterior"), F.col("length"), F.col("p_value"), [F.col(c) for c in ("f1", "f2", "f3")], F.col("n"))
        rows = tree.join(found.select(F.col("branch").alias("u"), note.alias("note"), "length"), "u", "left")
    text = dp.newick(rows, trees.taxa, trees.words)
    top = tree.agg(F.max("score").alias("score")).crossJoin(trees.status.agg(F.count_if(F.col("status") == "ok").alias("n_trees"))).crossJoin(trees.root.select("is_complete"))
    return text.select("newick").crossJoin(top)


def derived_trees(spark: SparkSession, sf_dir: str, taxa: str = "nation", shape: str = "dyadic", monthly: bool = False, parts: bool = False) -> Collection:
    """The collection that orders and customers give, or a tree for each part, or trees of suppliers; taxa keep their numbers."""
    if taxa == "supplier":
        found = derived.supplier_leaves(spark, sf_dir)
    else:
        found = derived.part_leaves(spark, sf_dir) if parts else derived.gene_leaves(spark, sf_dir, taxa, monthly)
    leaves = settle(found, "gene-leaves")
    levels = max(1, (leaves.agg(F.max("pos")).first()[0] or 0).bit_length())
    names = leaves.select("taxon").distinct().select("taxon", derived.label(F.col("taxon")).alias("label"))
    return Collection(derived.newick(leaves, shape, levels), taxa=settle(names, "taxa"))

"""From parsed trees to taxa, subtree splits, split frequencies and clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladeworks.functions import bits
from cladeworks.operators.blocks import limited
from cladeworks.session import settle

#: Most taxa (a label and a number each) that are broadcast to every task; beyond, they are joined.
MOST_TAXA = 1_000_000
#: Leaves of trees that a task makes the nodes of together (some 150 bytes each).
LEAVES = 500_000


def dictionary(leaves: DataFrame) -> DataFrame:
    """taxon, label: the distinct labels of accepted trees, numbered in their order.

    Labels are sorted in ranges; a label's number is its place in its range and the sizes of the ranges before.
    """
    ranged = leaves.select("label").distinct().repartitionByRange("label").sortWithinPartitions("label")
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)  # the low bits count the rows of a partition
    ranged = settle(ranged.select("label", F.spark_partition_id().alias("part"), place.alias("i")), "labels")
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = ranged.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(before, F.lit(0)).alias("before"))  # a row for each range
    return ranged.join(F.broadcast(parts), "part").select((F.col("before") + F.col("i")).cast("int").alias("taxon"), "label")


def _hint(taxa: DataFrame) -> DataFrame:
    return F.broadcast(taxa) if taxa.limit(MOST_TAXA + 1).count() <= MOST_TAXA else taxa


def leaf_order(leaves: DataFrame, taxa: DataFrame) -> DataFrame:
    """tree_id, taxon, pos of each leaf: the order of a tree by pos, the inverse index by taxon (no row: absent)."""
    return leaves.join(_hint(taxa), "label").select("tree_id", "taxon", F.col("pos").cast("long").alias("pos"))


def _sides(n: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in limited(batches, "w0", LEAVES):
            flat = lambda c: b.column(c).flatten().to_numpy()  # noqa: B023, E731
            leaves, sizes = np.diff(b.column("w0").offsets.to_numpy()), np.diff(b.column("start").offsets.to_numpy())
            base = np.repeat(np.concatenate([[0], np.cumsum(leaves)[:-1]]), sizes)
            start, mid, end = (flat(c) for c in ("start", "mid", "end"))
            upto = [np.concatenate([[0], np.bitwise_xor.accumulate(flat(f"w{i}"))]) for i in range(n or 2)]  # one run over all trees will do

            def side(x, y):
                words = [u[base + x] ^ u[base + y] for u in upto] + [y - x] * (n == bits.HASHED)  # noqa: B023
                return pa.StructArray.from_arrays([pa.array(w) for w in words], names=[f"w{i}" for i in range(len(words))])

            tree = b.column("tree_id").take(pa.array(np.repeat(np.arange(b.num_rows), sizes)))
            yield pa.record_batch([tree, pa.array(start), pa.array(mid), pa.array(end), side(start, mid), side(mid, end)], names=["tree_id", "start", "mid", "end", "left", "right"])

    return run


def node_splits(trees: DataFrame, taxa: DataFrame, n: int) -> DataFrame:
    """tree_id, start, mid, end, left, right of each internal node of trees (tree_id, labels, start, mid, end): its leaf interval, and its two sides as sets (of n words, or hashed).

    The XOR of single-taxon sets along a tree's leaves is the set of all leaves so far; a side is the difference of two of
    these, so no leaf is ever joined to a node. A hashed set's size is the length of its interval.
    """
    one = bits.singleton(F.col("taxon"), n)[: n or 2]
    leaves = trees.select("tree_id", F.posexplode("labels").alias("pos", "label")).join(_hint(taxa), "label")
    rows = leaves.select("tree_id", "pos", *(w.alias(f"w{i}") for i, w in enumerate(one))).groupBy("tree_id")
    rows = rows.agg(F.array_sort(F.collect_list(F.struct("pos", *(f"w{i}" for i in range(len(one)))))).alias("x"))
    word = lambda i: F.transform("x", lambda v: v[f"w{i}"]).alias(f"w{i}")
    both = rows.select("tree_id", *map(word, range(len(one)))).join(trees.select("tree_id", "start", "mid", "end"), "tree_id")
    kind, of = bits.kind(n), dict(trees.dtypes)["tree_id"]
    return both.mapInArrow(_sides(n), f"tree_id {of}, start long, mid long, end long, left {kind}, right {kind}")


def spans(nodes: DataFrame) -> DataFrame:
    """tree_id, start, mid, end: the nodes of a tree as arrays, by their first leaf."""
    rows = nodes.groupBy("tree_id").agg(F.array_sort(F.collect_list(F.struct("start", "mid", "end"))).alias("s"))
    field = lambda c: F.transform("s", lambda x: x[c]).alias(c)
    return rows.select("tree_id", *map(field, ("start", "mid", "end")))


def frequencies(nodes: DataFrame) -> DataFrame:
    """a, b, freq: distinct splits, the smaller set first, and how often each occurs; first: tree_id, start, mid, end of its first occurrence."""
    first = F.min(F.struct("tree_id", "start", "mid", "end")).alias("first")
    return nodes.groupBy(F.least("left", "right").alias("a"), F.greatest("left", "right").alias("b")).agg(F.count("*").alias("freq"), first)


def clusters(splits: DataFrame, n: int) -> DataFrame:
    """mask, size of all distinct sides and unions of splits."""
    every = splits.select(F.explode(F.array("a", "b", bits.union("a", "b", n))).alias("mask")).distinct()
    return every.select("mask", bits.size("mask", n).alias("size"))


def root_cluster(nodes: DataFrame, leaves: DataFrame, taxa: DataFrame, n: int) -> DataFrame:
    """root_tree, mask, n_leaves, is_complete: the leaves of the first tree with all taxa, or else of the first largest tree."""
    sizes = leaves.groupBy("tree_id").agg(F.count("*").alias("n_leaves"))
    best = sizes.agg(F.min_by("tree_id", F.struct(-F.col("n_leaves"), "tree_id")).alias("root_tree"), F.max("n_leaves").alias("n_leaves"))
    roots = nodes.where("start = 0").select("tree_id", F.col("end"), bits.union("left", "right", n).alias("mask"))
    best = best.join(roots, (F.col("root_tree") == F.col("tree_id")) & (F.col("end") == F.col("n_leaves")), "left")
    return best.crossJoin(taxa.agg(F.count("*").alias("n_taxa"))).select("root_tree", "mask", "n_leaves", (F.col("n_leaves") == F.col("n_taxa")).alias("is_complete"))


def coverage(order: DataFrame) -> DataFrame:
    """One row about all trees: how many taxa they have and lack."""
    sizes = order.groupBy("tree_id").agg(F.count("*").alias("n"))
    n = order.select(F.count_distinct("taxon").alias("n_taxa"))
    row = sizes.agg(F.count("*").alias("n_trees"), F.sum("n").alias("n_leaves"), F.min("n").alias("smallest"), F.max("n").alias("largest")).crossJoin(n)
    cells = F.col("n_trees") * F.col("n_taxa")
    return row.select("n_trees", "n_taxa", "n_leaves", "smallest", "largest", (cells - F.col("n_leaves")).alias("n_missing"), (F.col("n_leaves") * 100.0 / cells).alias("coverage_pct"))


def _agree(first, rows):
    """key, tree_id, start, mid, end, same: whether the leaves of each interval are those of the first one of its key."""
    import numpy as np
    import pyarrow as pa

    from cladeworks.operators import orders

    kept = ("key", "tree_id", "start", "mid", "end")
    if not first.num_rows or not rows.num_rows:
        return pa.table({c: rows[c] for c in kept} | {"same": pa.nulls(rows.num_rows, pa.bool_())}).slice(0, 0)
    index = orders.RangeIndex(orders.lists(first["one"])[0], orders.lists(first["two"])[0])
    s, m, e, x, y, z = (rows[c].to_numpy().astype(np.int64) for c in ("start", "mid", "end", "f_start", "f_mid", "f_end"))
    inside = lambda a, b, c, d: (b - a == d - c) & (index.common(a, b, c, d) == b - a)
    same = (inside(s, m, x, y) & inside(m, e, y, z)) | (inside(s, m, y, z) & inside(m, e, x, y)) if first["halves"][0].as_py() else inside(s, e, x, z)
    return pa.table({c: rows[c] for c in kept} | {"same": pa.array(same)})


def check_groups(occurrences: DataFrame, arrays: DataFrame, halves: bool = False) -> DataFrame:
    """key, tree_id, start, mid, end, part: occurrences (tree_id, start, mid, end, key) of sets that hashes say are equal, told apart by their leaves.

    The leaves from start to end of the first occurrence of a key and of each other one are counted, by an index of the
    two trees' orders (arrays: tree_id, order): they are equal if all are common. (``halves``: both sides of a split are, in
    either order.) Those that are not get part 1 and are compared among themselves, and so on: part 0 alone means that
    no hash stands for two sets.
    """
    place = F.struct("tree_id", "start", "mid", "end")
    left, out, number = settle(occurrences.select("key", "tree_id", "start", "mid", "end"), "occurrences"), None, 0
    while True:
        first = left.groupBy("key").agg(F.min(place).alias("f"), F.count("*").alias("n"))
        rows = left.join(first, "key").select("key", "tree_id", "start", "mid", "end", F.col("f.tree_id").alias("f_tree"), *(F.col(f"f.{c}").alias(f"f_{c}") for c in ("start", "mid", "end")))
        pairs = rows.select(F.col("f_tree").alias("tree_a"), F.col("tree_id").alias("tree_b")).distinct()
        orders_of = lambda c, k: arrays.select(F.col("tree_id").alias(c), F.col("order").alias(k))
        indexed = pairs.join(orders_of("tree_b", "one"), "tree_b").join(orders_of("tree_a", "two"), "tree_a").withColumn("halves", F.lit(halves))
        kinds = dict(left.dtypes)
        schema = ", ".join(f"{c} {kinds[c]}" for c in ("key", "tree_id", "start", "mid", "end")) + ", same boolean"
        found = settle(indexed.groupBy("tree_a", "tree_b").cogroup(rows.groupBy("f_tree", "tree_id")).applyInArrow(_agree, schema), "agreement")
        own = found.where("same").drop("same").withColumn("part", F.lit(number))
        out = own if out is None else out.unionByName(own)
        left, number = found.where("not same").drop("same"), number + 1
        if left.isEmpty():
            return out

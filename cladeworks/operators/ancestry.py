"""Ancestors and lowest common nodes: a node is above another one if its leaf interval holds the other's."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladeworks.operators.splits import spans
from cladeworks.session import settle

#: Questions about one tree that a task answers at a time at most.
QUESTIONS = 100_000


def depths(nodes: DataFrame) -> DataFrame:
    """tree_id, start, end, n_above: how many nodes are above each internal node (tree_id, start, end).

    Intervals open and close along the leaves; those that are open where a node opens, before it, are above it. So this is
    a running sum of a tree's openings and closings, whose number is twice that of its nodes.
    """
    begins = nodes.select("tree_id", F.col("start").alias("place"), F.lit(1).alias("step"), (-F.col("end")).alias("then"), "start", "end")
    ends = nodes.select("tree_id", F.col("end").alias("place"), F.lit(-1).alias("step"), F.lit(None).cast("int").alias("then"), "start", "end")
    along = Window.partitionBy("tree_id").orderBy("place", "step", "then").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = begins.unionByName(ends).withColumn("n_above", F.sum("step").over(along).cast("long") - 1)
    return found.where("step = 1").select("tree_id", "start", "end", "n_above")


def _above(nodes):
    import pyarrow as pa

    rows = sorted(zip(nodes["start"].to_pylist(), nodes["end"].to_pylist(), strict=True), key=lambda x: (x[0], -x[1]))
    open_nodes: list[tuple[int, int]] = []
    out: list[list[int]] = [[], [], [], []]
    for start, end in rows:
        while open_nodes and open_nodes[-1][1] <= start:
            open_nodes.pop()
        for x, y in open_nodes:
            for column, v in zip(out, (start, end, x, y), strict=True):
                column.append(v)
        open_nodes.append((start, end))
    tree = nodes["tree_id"].combine_chunks().take(pa.array([0] * len(out[0]), pa.int32()))
    names = ("start", "end", "above_start", "above_end")
    return pa.table({"tree_id": tree} | {k: pa.array(c, nodes.schema.field(k.removeprefix("above_")).type) for k, c in zip(names, out, strict=True)})


def ancestors(nodes: DataFrame) -> DataFrame:
    """tree_id, start, end, above_start, above_end: each internal node (tree_id, start, end) with each node above it.

    A task sweeps over a tree's nodes by their first leaf and keeps those that are open, so it costs what it returns.
    """
    rows = nodes.select("tree_id", "start", "end")
    kinds = dict(rows.dtypes)
    schema = f"tree_id {kinds['tree_id']}, start {kinds['start']}, end {kinds['end']}, above_start {kinds['start']}, above_end {kinds['end']}"
    return rows.groupBy("tree_id").applyInArrow(_above, schema)


def _lowest(trees, leaves):
    import numpy as np
    import pyarrow as pa

    from cladeworks.operators import orders

    if not trees.num_rows or not leaves.num_rows:
        return pa.table({c: leaves[c] for c in ("tree_id", "p", "q")} | {c: pa.nulls(leaves.num_rows, pa.int64()) for c in ("start", "end")}).slice(0, 0)
    s, m, e = (orders.lists(trees[c])[0] for c in ("start", "mid", "end"))
    n = int(e.max())
    tree = orders.Order(np.arange(n), s, m, e)
    p, q = (leaves[c].to_numpy() for c in ("p", "q"))
    low, high = np.minimum(p, q), np.maximum(p, q)
    # the lowest node above one leaf is the smaller of the nodes on either side of it
    left, right = np.maximum(low, 1), np.minimum(low + 1, n - 1)
    parent = np.where((low > 0) & ((low == n - 1) | (tree.size[left] <= tree.size[right])), left, right)
    at = np.where(low == high, parent, 0)
    two = low < high
    at[two] = tree.common(low[two], high[two])
    return pa.table({c: leaves[c] for c in ("tree_id", "p", "q")} | {"start": pa.array(tree.start[at]), "end": pa.array(tree.end[at])})


def lowest_common(nodes: DataFrame, leaves: DataFrame) -> DataFrame:
    """tree_id, p, q, start, end: the lowest node above the leaves at places p and q, for each row (tree_id, p, q) of ``leaves``.

    nodes: tree_id, start, mid, end. Two places that are one have the lowest node above that leaf. A tree's nodes get a
    table of largest ones over doubling spans of places, n log n numbers, and two looks at it answer a question. Trees with
    over QUESTIONS questions have these dealt to tasks of their own, each with the tree.
    """
    leaves = leaves.select("tree_id", F.col("p").cast("long").alias("p"), F.col("q").cast("long").alias("q")).distinct()
    hot = settle(leaves.groupBy("tree_id").count().where(F.col("count") > QUESTIONS).select("tree_id", F.ceil(F.col("count") / QUESTIONS).cast("int").alias("parts")), "asked-trees")
    parts = F.coalesce("parts", F.lit(1))
    asked = leaves.join(hot, "tree_id", "left").withColumn("part", F.pmod(F.xxhash64("p", "q"), parts).cast("int")).drop("parts")
    trees = spans(nodes).join(hot, "tree_id", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    kind = dict(leaves.dtypes)["tree_id"]
    return trees.groupBy("tree_id", "part").cogroup(asked.groupBy("tree_id", "part")).applyInArrow(_lowest, f"tree_id {kind}, p long, q long, start long, end long")

"""Quartet counts around the branches of a species tree, from set overlaps instead of leaf by leaf."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeworks.functions import bits
from cladeworks.operators.blocks import against
from cladeworks.operators.weights import tree_arrays, trees_of_a_block
from cladeworks.session import settle

#: Rows of branches and of splits that meet in one task; least tasks that count along leaf orders, if trees are as many.
BRANCHES, SPLITS, TASKS = 512, 4096, 64


def quadripartitions(tree: DataFrame, every: DataFrame, n: int) -> DataFrame:
    """branch, q1, q2, q3, q4 for each inner branch of a tree (u, a, b); ``every`` holds one row, mask, of all its taxa.

    q1 and q2 are the parts below the branch; q3 and q4 those of its sibling. A sibling that is a leaf is q3, and
    all other taxa are q4. Branches with an empty set are left out.
    """
    up = tree.select(F.col("u").alias("p"), F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("sibling")), F.struct(F.col("b").alias("u"), F.col("a").alias("sibling")))).alias("x"))
    up = up.select("x.*")
    beside = tree.select(F.col("u").alias("sibling"), F.col("a").alias("c"), F.col("b").alias("d"))
    rows = tree.join(up, "u").join(beside, "sibling", "left").join(F.broadcast(every.select(F.col("mask").alias("all")).limit(1)), F.lit(True))
    rest = bits.minus(bits.minus("all", "u", n), "sibling", n)
    rows = rows.select(F.col("u").alias("branch"), F.col("a").alias("q1"), F.col("b").alias("q2"), F.coalesce("c", "sibling").alias("q3"), F.when(F.col("c").isNotNull(), F.col("d")).otherwise(rest).alias("q4"))
    return rows.where(bits.size("q4", n) > 0)


def _count(n: int):
    def run(branches, rows):
        import numpy as np
        import pyarrow as pa

        words = lambda t, c: np.array([list(x.values()) for x in t[c].to_pylist()], np.int64).reshape(-1, n)
        freq, whole = rows["freq"].to_numpy().astype(np.int64), np.array(rows["whole"].to_pylist(), bool)
        sides = [words(rows, "a"), words(rows, "b")]
        total = np.zeros((4, branches.num_rows), np.int64)
        quads = [words(branches, f"q{i}") for i in range(1, 5)]
        for k in range(branches.num_rows):
            a, b, c, d = ([np.bitwise_count(q[k] & s).sum(1, dtype=np.int64) for s in sides] for q in quads)
            for i, (p, q, r, s) in enumerate(((a, b, c, d), (a, c, b, d), (a, d, b, c))):
                both = p[0] * q[0] * r[1] * s[1] + p[1] * q[1] * r[0] * s[0]
                total[i, k] = both[~whole] @ freq[~whole]
            total[3, k] = (a[0] * b[0] * c[0] * d[0])[whole] @ freq[whole]
        return pa.table({"branch": branches["branch"], **{f: pa.array(t) for f, t in zip(("f1", "f2", "f3", "n"), total, strict=True)}})

    return run


def frequencies(quads: DataFrame, splits: DataFrame, leaf_sets: DataFrame, n: int) -> DataFrame:
    """branch, f1, f2, f3, n, possible: resolved quartets of each topology, all quartets in the trees, and those of one tree.

    splits: a, b, freq. leaf_sets: mask, freq of the trees' leaf sets. A split of a tree resolves four leaves, one of
    each set, if it has two of them on either side; only such balanced quartets are counted as resolved.
    """
    every = splits.select("a", "b", "freq", F.lit(False).alias("whole")).unionByName(leaf_sets.select(F.col("mask").alias("a"), F.col("mask").alias("b"), "freq", F.lit(True).alias("whole")))
    kind = dict(quads.dtypes)["branch"]
    parts = against(quads, every, _count(n), f"branch {kind}, f1 long, f2 long, f3 long, n long", (BRANCHES, SPLITS))
    sums = parts.groupBy("branch").agg(*(F.sum(c).alias(c) for c in ("f1", "f2", "f3", "n")))
    sizes = [bits.size(f"q{i}", n) for i in range(1, 5)]
    return quads.select("branch", (sizes[0] * sizes[1] * sizes[2] * sizes[3]).alias("possible")).join(sums, "branch").select("branch", "f1", "f2", "f3", "n", "possible")


def _families(nodes: DataFrame) -> DataFrame:
    """start, left_mid, mid, right_mid, end of each node of a tree that has an internal child; a mid is null for a leaf."""
    parts = nodes.select(F.col("start").cast("long").alias("start"), F.col("mid").cast("long").alias("mid"), F.col("end").cast("long").alias("end"))
    left = parts.select("start", F.col("mid").alias("left_mid"), F.col("end").alias("mid"))
    right = parts.select(F.col("start").alias("mid"), F.col("mid").alias("right_mid"), "end")
    return parts.join(left, ["start", "mid"], "left").join(right, ["mid", "end"], "left").where("left_mid is not null or right_mid is not null").select("start", "left_mid", "mid", "right_mid", "end")


def _along(tree, trees):
    import numpy as np
    import pyarrow as pa

    from cladeworks.operators import orders

    if not tree.num_rows:
        return pa.table({c: pa.nulls(0, pa.int64()) for c in ("start", "mid", *(f"{f}_{k}" for k in ("high", "low") for f in ("f1", "f2", "f3", "n")))})
    order, start, mid, end = (orders.lists(tree[c])[0] for c in ("order", "start", "mid", "end"))
    own = orders.Own(order, start, mid, end, mid)
    counts = orders.quartets(own, list(zip(*(orders.lists(trees[c]) for c in ("order", "start", "mid", "end")), strict=True)))
    mid = mid[(own.left[mid] > 0) | (own.right[mid] > 0)]
    return pa.table({"start": pa.array(own.start[mid].astype(np.int64)), "mid": pa.array(mid.astype(np.int64))} | {f"{f}_{k}": pa.array(x[i][mid]) for k, x in zip(("high", "low"), counts, strict=True) for i, f in enumerate(("f1", "f2", "f3", "n"))})


def frequencies_along(nodes: DataFrame, order: DataFrame, taxa: DataFrame, trees: DataFrame) -> DataFrame:
    """start, end, f1, f2, f3, n, possible of the inner branches of one tree, as ``frequencies`` counts them, for any number of taxa.

    nodes (start, mid, end) and order (taxon, pos) are the tree's; taxa (taxon) all there are; trees (tree_id, order, start,
    mid, end as arrays) the gene trees. A branch is known by the leaves below it. Its first two sets are its parts in leaf
    order, the others those of its sibling, or a leaf that is its sibling and all other taxa. The sets of two sibling
    branches are the same, so they are counted once, by their parent: its leaves, with four colours, in each gene tree's
    order, are counted at the nodes where they branch. So a branch costs its parent's leaves, not all taxa, for each
    tree. Counts are exact, as decimals.
    """
    sizes = taxa.select("taxon").distinct().count()
    one = lambda df: df.withColumn("tree_id", F.lit(0))
    own = settle(tree_arrays(one(order), one(nodes)).select("order", "start", "mid", "end"), "own")
    families = settle(_families(nodes), "families")
    kinds = ", ".join(f"{f}_{k} long" for k in ("high", "low") for f in ("f1", "f2", "f3", "n"))
    block = trees_of_a_block(trees, TASKS)
    parts = against(own, trees.select("order", "start", "mid", "end"), _along, f"start long, mid long, {kinds}", (1, block))
    total = lambda f: (F.sum(F.col(f"{f}_high").cast("decimal(28,0)")) * F.lit(2**32).cast("decimal(10,0)") + F.sum(F.col(f"{f}_low").cast("decimal(28,0)"))).cast("decimal(38,0)").alias(f)
    sums = parts.groupBy("start", "mid").agg(*map(total, ("f1", "f2", "f3", "n")))
    s, x, m, y, e = (F.col(c) for c in ("start", "left_mid", "mid", "right_mid", "end"))
    one, two = x.isNotNull(), y.isNotNull()
    far = F.when(one & two, F.lit(None)).otherwise(F.lit(sizes) - (e - s))
    pair = lambda a, b: F.coalesce(a, F.lit(1)).cast("decimal(19,0)") * F.coalesce(b, F.lit(1)).cast("decimal(19,0)")
    left, right = pair(x - s, m - x), pair(y - m, e - y)
    possible = F.when(one & two, left * right).when(one, left * pair(e - m, far)).otherwise(right * pair(m - s, far)).cast("decimal(38,0)")
    branch = lambda there, a, b: F.when(there, F.struct(a.alias("start"), b.alias("end")))
    rows = families.join(sums, ["start", "mid"]).where(far.isNull() | (far > 0)).withColumn("possible", possible)
    rows = rows.withColumn("branch", F.explode(F.filter(F.array(branch(one, s, m), branch(two, m, e)), lambda z: z.isNotNull())))
    return rows.select("branch.start", "branch.end", "f1", "f2", "f3", "n", "possible")


def checks(counts: DataFrame) -> DataFrame:
    """Counts of branches whose frequencies are negative, exceed n, or do not sum to n, and whose n exceeds one tree's quartets."""
    f = F.col("f1") + F.col("f2") + F.col("f3")
    n = lambda c: F.count_if(c)
    return counts.agg(n(F.least("f1", "f2", "f3") < 0).alias("negative"), n(F.greatest("f1", "f2", "f3") > F.col("n")).alias("above_n"), n(f != F.col("n")).alias("not_all_resolved"), n(F.col("n") > F.col("possible")).alias("above_possible"))

"""Triplet agreement: the weight of a candidate split is the sum of its scores with all splits of the gene trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeworks.functions import bits
from cladeworks.operators.blocks import against
from cladeworks.operators.splits import spans
from cladeworks.session import settle

#: Rows of candidates and of splits that meet in one task; trees of a block whose candidates bring their members.
BLOCK, TREES = 4096, 64
#: Bytes of the trees of a block, about; of a leaf, with a node; least number of blocks if trees are as many.
BLOCK_BYTES, LEAF_BYTES, LEAST_BLOCKS = 1 << 26, 32, 8
#: Questions about two trees that a task answers at a time at most.
QUESTIONS = 500_000


def pair_score(p: Column, q: Column) -> Column:
    """Triplets that two overlaps of p and q taxa share: p q (p + q - 2) / 2, exact in 64 bits."""
    twice = p * q * (p + q - 2)
    return F.shiftright(twice, 1)


def score(aa: Column, bb: Column, ab: Column, ba: Column) -> Column:
    return pair_score(aa, bb) + pair_score(ab, ba)


def _masks(n: int):
    def run(candidates, splits):
        import numpy as np
        import pyarrow as pa

        words = lambda t, c: np.array([list(x.values()) for x in t[c].to_pylist()], np.int64).reshape(-1, n)
        la, lb, ra, rb = words(candidates, "a"), words(candidates, "b"), words(splits, "a"), words(splits, "b")
        freq = splits["freq"].to_numpy().astype(np.int64)
        total = np.zeros(len(la), np.int64)
        common = lambda x, y: np.bitwise_count(x[:, None, :] & y[None, :, :]).sum(2, dtype=np.int64)
        for i in range(0, len(la), 256):
            a, b = la[i : i + 256], lb[i : i + 256]
            for p, q in ((common(a, ra), common(b, rb)), (common(a, rb), common(b, ra))):
                total[i : i + 256] += (p * q * (p + q - 2) // 2) @ freq
        return pa.table({"a": candidates["a"], "b": candidates["b"], "part": pa.array(total)})

    return run


def weights(candidates: DataFrame, splits: DataFrame, n: int) -> DataFrame:
    """a, b, weight of each distinct candidate (a, b): sum of freq times score over the distinct splits (a, b, freq).

    Sets are compared as words of bits, block by block; sums are exact up to 2**63.
    """
    block = max(64, BLOCK * 16 // (n + 15))  # of sets, about as many bytes whatever their words
    parts = against(candidates.select("a", "b"), splits.select("a", "b", "freq"), _masks(n), f"a {bits.kind(n)}, b {bits.kind(n)}, part long", (block, block))
    found = parts.groupBy("a", "b").agg(F.sum("part").alias("weight"))
    return candidates.select("a", "b").join(found, ["a", "b"], "left").withColumn("weight", F.coalesce("weight", F.lit(0)))


def overlaps(candidates: DataFrame, splits: DataFrame) -> DataFrame:
    """c, s, aa, bb, ab, ba: sizes of the four overlaps of each two splits that share a taxon on some side, by joins.

    Both tables are members (id, side, taxon). This is the relational form: the join grows with the product of how
    many splits hold a taxon, so it serves small tables and as a check of the others.
    """
    c, s = candidates.toDF("c", "cside", "taxon"), splits.toDF("s", "sside", "taxon")
    count = lambda x, y: F.sum(((F.col("cside") == x) & (F.col("sside") == y)).cast("long"))
    return c.join(s, "taxon").groupBy("c", "s").agg(count(0, 0).alias("aa"), count(1, 1).alias("bb"), count(0, 1).alias("ab"), count(1, 0).alias("ba"))


def _orders(candidates, trees):
    import numpy as np
    import pyarrow as pa

    total = np.zeros(candidates.num_rows, np.int64)
    orders = [(np.array(o), np.array(s), np.array(m), np.array(e)) for o, s, m, e in zip(*(trees[c].to_pylist() for c in ("order", "start", "mid", "end")), strict=True)]
    n = 1 + max((int(o.max()) for o, *_ in orders if len(o)), default=0)
    for k, (left, right) in enumerate(zip(candidates["left"].to_pylist(), candidates["right"].to_pylist(), strict=True)):
        sides = np.zeros((2, n), np.int64)
        for row, taxa in zip(sides, (left, right), strict=True):
            taxa = np.array(taxa)
            row[taxa[taxa < n]] = 1
        for order, start, mid, end in orders:
            runs = np.concatenate([np.zeros((2, 1), np.int64), np.cumsum(sides[:, order], axis=1)], axis=1)
            first, last = runs[:, mid] - runs[:, start], runs[:, end] - runs[:, mid]
            for p, q in ((first[0], last[1]), (last[0], first[1])):
                total[k] += int((p * q * (p + q - 2) // 2).sum())
    return pa.table({"id": candidates["id"], "part": pa.array(total)})


def weights_by_order(candidates: DataFrame, trees: DataFrame) -> DataFrame:
    """id, weight for candidates (id, left array<int>, right array<int>) over trees (tree_id, order, start, mid, end arrays).

    For many taxa: no set is stored for a gene tree's splits. Running counts of a candidate's two sides along a
    tree's leaf order give the overlaps with all of the tree's splits at once.
    """
    parts = against(candidates.select("id", "left", "right"), trees.select("tree_id", "order", "start", "mid", "end"), _orders, "id long, part long", (256, TREES))
    return parts.groupBy("id").agg(F.sum("part").alias("weight"))


def tree_arrays(order: DataFrame, nodes: DataFrame) -> DataFrame:
    """tree_id, order, start, mid, end: a row for each tree, for ``weights_by_order``."""
    by_pos = F.transform(F.array_sort(F.collect_list(F.struct("pos", "taxon"))), lambda x: x["taxon"])
    nodes = nodes.select("tree_id", *(F.col(c).cast("int").alias(c) for c in ("start", "mid", "end")))
    return order.groupBy("tree_id").agg(by_pos.alias("order")).join(spans(nodes), "tree_id").select("tree_id", "order", "start", "mid", "end")


def _common(pairs, questions):
    import pyarrow as pa

    from cladeworks.operators import orders

    if not pairs.num_rows or not questions.num_rows:
        return pa.table({"id": questions["id"], "common": pa.nulls(questions.num_rows, pa.int64())}).slice(0, 0)
    index = orders.RangeIndex(orders.lists(pairs["one"])[0], orders.lists(pairs["two"])[0])
    return pa.table({"id": questions["id"], "common": pa.array(index.common(*(questions[c].to_numpy() for c in ("start_1", "end_1", "start_2", "end_2"))))})


def range_overlaps(questions: DataFrame, trees: DataFrame, most: int = QUESTIONS) -> DataFrame:
    """id, common: how many leaves two ranges of two trees' orders share, for questions (id, tree_1, start_1, end_1, tree_2, start_2, end_2).

    trees: tree_id, order. For two trees that are asked about an index is built once, of n log n numbers, and each question
    takes log n steps. Two trees with over ``most`` questions have these dealt to tasks, each with an index.
    """
    pair = ["tree_1", "tree_2"]
    sizes = questions.groupBy(*pair).agg(F.ceil(F.count("*") / most).cast("int").alias("parts"))
    sizes = settle(sizes, "asked-pairs")
    one, two = (trees.select(F.col("tree_id").alias(c), F.col("order").alias(k)) for c, k in zip(pair, ("one", "two"), strict=True))
    indexed = sizes.join(one, "tree_1").join(two, "tree_2").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    several = sizes.where("parts > 1")
    dealt = questions.join(several, pair, "left").withColumn("part", F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    long = lambda c: F.col(c).cast("long").alias(c)
    dealt = dealt.select(*pair, "part", *map(long, ("id", "start_1", "end_1", "start_2", "end_2")))
    return indexed.groupBy(*pair, "part").cogroup(dealt.groupBy(*pair, "part")).applyInArrow(_common, "id long, common long")


def _ranges(one, trees):
    import numpy as np
    import pyarrow as pa

    from cladeworks.operators import orders

    met = list(zip(*(orders.lists(trees[c]) for c in ("order", "start", "mid", "end")), strict=True))
    parts = []
    for *arrays, wanted in zip(*(orders.lists(one[c]) for c in ("order", "start", "mid", "end", "wanted")), strict=True):
        parts.append(orders.agreement(orders.Own(*arrays, wanted), met)[wanted])
    cuts = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.table({"tree_id": one["tree_id"], "mid": one["wanted"], "part": pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate([np.zeros(0, np.int64), *parts])))})


def _added(rows):
    """tree_id, mid, weight of one tree's splits: the sums of the blocks' parts."""
    import numpy as np
    import pyarrow as pa

    from cladeworks.operators import orders

    mid = orders.lists(rows["mid"])[0]
    return pa.table({"tree_id": pa.repeat(rows["tree_id"][0], len(mid)), "mid": pa.array(mid), "weight": pa.array(np.sum(orders.lists(rows["part"]), axis=0))})


def weights_by_ranges(splits: DataFrame, trees: DataFrame) -> DataFrame:
    """a, b, weight of each distinct split (a, b, first) over trees (tree_id, order, start, mid, end arrays), as ``weights`` gives them.

    The way for many taxa: memory is that of the trees' leaf orders. A split is a node of the first tree that has it; trees
    with such nodes meet all trees in blocks of bounded bytes, and a task adds up what a block gives. A split agrees with a
    tree only at nodes that have leaves of it in both of their parts. These are one fewer than its leaves, and are told from
    those of the node above by counting, so a tree's splits cost together their sizes for each tree, not taxa times splits.
    """
    first = splits.groupBy(F.col("first.tree_id").alias("tree_id")).agg(F.array_sort(F.collect_list(F.col("first.mid").cast("int"))).alias("wanted"))
    one = settle(first.join(trees, "tree_id").select("tree_id", "order", "start", "mid", "end", "wanted"), "candidates")
    size, kind = trees_of_a_block(trees), dict(trees.dtypes)["tree_id"]
    parts = against(one, trees.select("order", "start", "mid", "end"), _ranges, f"tree_id {kind}, mid array<int>, part array<long>", (size, size))
    found = parts.groupBy("tree_id").applyInArrow(_added, f"tree_id {kind}, mid int, weight long")
    return splits.join(found, (F.col("first.tree_id") == found["tree_id"]) & (F.col("first.mid") == found["mid"])).select("a", "b", "weight")


def trees_of_a_block(trees: DataFrame, least: int = LEAST_BLOCKS) -> int:
    """How many trees, by leaf orders and nodes, come to about BLOCK_BYTES; fewer if there would be fewer than ``least`` blocks."""
    n, leaves = trees.agg(F.count("*"), F.max(F.size("order"))).first()
    return max(1, min(BLOCK_BYTES // (max(2, leaves or 0) * LEAF_BYTES), -(-n // least)))

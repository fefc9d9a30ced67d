"""Distances between trees by their sets of splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeworks.functions import bits
from cladeworks.operators.blocks import against
from cladeworks.session import settle

#: Trees of either side that meet in one task, and bytes of their splits, at most; splits that are marked at a time.
TREES, BLOCK_BYTES, AT_ONCE = 256, 1 << 25, 8192


def unrooted(nodes: DataFrame, n: int) -> DataFrame:
    """tree_id, s: the distinct splits of each tree without its root that have two leaves or more on either side.

    A split is known by the smaller of its two sides; two sides make the tree's leaf set.
    """
    own = nodes.select("tree_id", "start", bits.union("left", "right", n).alias("u"))
    whole = own.where("start = 0").groupBy("tree_id").agg(F.max_by("u", bits.size("u", n)).alias("whole"))
    rows = own.join(whole, "tree_id").withColumn("other", bits.minus("whole", "u", n))
    return rows.where((bits.size("u", n) > 1) & (bits.size("other", n) > 1)).select("tree_id", F.least("u", "other").alias("s")).distinct()


def normed(distance: Column, n_taxa: Column | int) -> Column:
    n = F.lit(n_taxa) if isinstance(n_taxa, int) else n_taxa
    return F.when(n <= 3, F.lit(0.0)).otherwise(F.least(F.lit(1.0), distance / (2.0 * (n - 3))))


def _pairs(x, y):
    import numpy as np
    import pyarrow as pa

    from cladeworks.operators.orders import lists

    ids, rows, keys = [], [], []
    for t in (x, y):
        sets = lists(t["keys"])
        ids.append(t["tree_id"].to_numpy())
        rows.append(np.repeat(np.arange(len(sets)), [len(k) for k in sets]))
        keys.append(np.concatenate([np.zeros(0, np.int64), *sets]))
    far = np.bincount(rows[0], minlength=len(ids[0]))[:, None] + np.bincount(rows[1], minlength=len(ids[1]))[None, :]
    shared = np.intersect1d(*keys)
    marks = [np.zeros((len(i), min(AT_ONCE, len(shared))), np.float32) for i in ids]
    at = [np.searchsorted(shared, k) for k in keys]
    there = [np.flatnonzero(shared[np.minimum(p, len(shared) - 1)] == k) if len(shared) else np.zeros(0, np.int64) for p, k in zip(at, keys, strict=True)]
    there = [i[np.argsort(p[i], kind="stable")] for i, p in zip(there, at, strict=True)]
    for low in range(0, len(shared), AT_ONCE):  # the splits that both blocks have, some at a time
        for m, r, p, i in zip(marks, rows, at, there, strict=True):
            own = i[slice(*np.searchsorted(p[i], (low, low + AT_ONCE)))]
            m[:] = 0
            m[r[own], p[own] - low] = 1
        far = far - 2 * (marks[0] @ marks[1].T).astype(np.int64)
    i, j = np.nonzero(ids[0][:, None] < ids[1][None, :])
    return pa.table({"tree_1": pa.array(ids[0][i]), "tree_2": pa.array(ids[1][j]), "distance": pa.array(far[i, j])})


def all_pairs(splits: DataFrame, trees: DataFrame) -> DataFrame:
    """tree_1, tree_2, distance of each two of ``trees`` (tree_id): splits (tree_id, s) that only one of them has.

    Trees meet in blocks of up to TREES, fewer if their splits would exceed BLOCK_BYTES; of these a task marks AT_ONCE at
    a time that both blocks have, so memory does not grow with the splits there are. Splits of one word are compared as
    they are, longer ones by the number of the distinct split.
    """
    words = splits.schema["s"].dataType.fieldNames()
    key = F.col(f"s.{words[0]}")
    if len(words) > 1:
        numbers = settle(splits.select("s").distinct().select("s", F.monotonically_increasing_id().alias("key")), "split-numbers")
        splits, key = splits.join(numbers, "s"), F.col("key")
    sets = trees.select("tree_id").distinct().join(splits.groupBy("tree_id").agg(F.collect_list(key).alias("keys")), "tree_id", "left")
    sets = settle(sets.select(F.col("tree_id").cast("long").alias("tree_id"), F.coalesce("keys", F.array().cast("array<bigint>")).alias("keys")), "split-sets")
    largest = sets.agg(F.max(F.size("keys"))).first()[0] or 1
    block = max(1, min(TREES, BLOCK_BYTES // (8 * max(1, largest))))
    return against(sets, sets, _pairs, "tree_1 long, tree_2 long, distance long", (block, block))


def to_one(splits: DataFrame, trees: DataFrame, species: DataFrame) -> DataFrame:
    """tree_id, distance of each tree to one species tree, whose splits (s) are joined to those of all others."""
    size = species.select("s").distinct().agg(F.count("*").alias("n_species"))
    own = splits.join(species.select("s").distinct().withColumn("common", F.lit(1)), "s", "left")
    own = own.groupBy("tree_id").agg(F.count("*").alias("n_own"), F.sum(F.coalesce("common", F.lit(0))).alias("n_common"))
    rows = trees.select("tree_id").distinct().join(own, "tree_id", "left").join(F.broadcast(size), F.lit(True))
    none = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return rows.select("tree_id", (none("n_own") + F.col("n_species") - 2 * none("n_common")).alias("distance"))


def nearness(rf: Column) -> Column:
    return F.when(rf < 0.3, "very similar").when(rf < 0.6, "moderately similar").otherwise("quite different")


def same_topology(clusters: DataFrame, trees: DataFrame, other: DataFrame) -> DataFrame:
    """tree_id, same: whether a tree has the rooted clusters (tree_id, u) of the other one (u), no more and no fewer."""
    found = to_one(clusters.select("tree_id", F.col("u").alias("s")), trees, other.select(F.col("u").alias("s")))
    return found.select("tree_id", (F.col("distance") == 0).alias("same"))

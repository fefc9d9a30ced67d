"""The species tree: for each cluster the split of greatest total agreement, from small clusters to the root's."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladeworks.functions import bits
from cladeworks.operators.components import components
from cladeworks.session import folder, settle

#: Candidate splits that one task solves at a time at most.
ONE_TASK = 200_000


def candidates(weighted: DataFrame, n: int) -> DataFrame:
    """u, a, b, weight: candidate splits with the cluster that each divides."""
    return weighted.select(bits.union("a", "b", n).alias("u"), "a", "b", "weight")


def best_local(weighted: DataFrame, n: int) -> DataFrame:
    """Of each cluster's candidates the one of greatest weight; of equal ones, that with the smallest sets."""
    order = Window.partitionBy("u").orderBy(F.desc("weight"), "a", "b")
    return candidates(weighted, n).withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def _band(rows):
    """The best split of each cluster of a task's rows, the smallest clusters first; ``below`` is what parts of earlier bands bring."""
    import pyarrow as pa

    key = lambda m: tuple(m.values())
    options: dict[tuple, list] = {}
    size: dict[tuple, int] = {}
    group: dict[tuple, int] = {}
    words: dict[tuple, dict] = {}
    names = ("u", "a", "b", "su", "weight", "below", "comp")
    for batch in rows:
        for u, a, b, su, weight, below, comp in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            ku, ka, kb = map(key, (u, a, b))
            words |= {ku: u, ka: a, kb: b}
            size[ku], group[ku] = su, comp
            options.setdefault(ku, []).append((weight + below, ka, kb))
    score: dict[tuple, int] = {}
    choice: dict[tuple, tuple] = {}
    for u in sorted(options, key=size.__getitem__):
        of = [(w + score.get(a, 0) + score.get(b, 0) if size[u] > 2 else 0, a, b) for w, a, b in options[u]]
        score[u] = max(s for s, *_ in of)
        choice[u] = min((a, b) for s, a, b in of if s == score[u])
    kind = pa.struct([(k, pa.int64()) for k in next(iter(words.values()), {"w0": 0})])
    columns = [[words[u] for u in choice], [words[a] for a, _ in choice.values()], [words[b] for _, b in choice.values()]]
    numbers = [pa.array([of[u] for u in choice], pa.int64()) for of in (size, score, group)]
    yield pa.record_batch([pa.array(c, kind) for c in columns] + numbers, names=["u", "a", "b", "su", "score", "comp"])


def _narrow(sizes: list[tuple[int, int]], most: int) -> list[tuple[int, int, int]]:
    """Sizes of clusters (size, number of candidates) in bands (least, greatest, candidates) of at most so many candidates, or of one size."""
    out: list[tuple[int, int, int]] = []
    for size, n in sizes:
        if out and out[-1][2] + n <= most:
            low, _, held = out.pop()
            out.append((low, size, held + n))
        else:
            out.append((size, size, n))
    return out


def _nested(options: DataFrame, n: int) -> DataFrame:
    """node, root: clusters (as hashes) that are linked, in their band of doubling sizes, by one being a part of the other."""
    band = lambda c: F.floor(F.log2(c.cast("double")) + 1e-9)
    parts = options.select("u", "su", F.explode(F.array("a", "b")).alias("part")).withColumn("sp", bits.size("part", n))
    return components(parts.where(band(F.col("su")) == band(F.col("sp"))).select(F.xxhash64("u").alias("u"), F.xxhash64("part").alias("v")))


def _plan(options: DataFrame, sizes: list[tuple[int, int]], n: int, most: int) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """The options with comp, what must be solved in one task, and the bands of sizes (least, greatest, candidates).

    If all fit a task, they are one band. Otherwise sizes from one power of two to the next are a band, and clusters of a
    band that do not nest in each other are solved apart; a band in which too many nest is cut into narrower ones.
    """
    if sum(k for _, k in sizes) <= most:
        return options.withColumn("comp", F.lit(0).cast("long")), _narrow(sizes, most)
    roots = _nested(options, n)
    placed = options.withColumn("node", F.xxhash64("u")).join(roots, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("node", "root")
    placed = settle(placed, "placed")
    largest = placed.groupBy(F.floor(F.log2(F.col("su").cast("double")) + 1e-9).alias("wide"), "comp").count().groupBy("wide").agg(F.max("count").alias("most"))
    largest = {r.wide: r.most for r in largest.collect()}  # a row for each power of two
    bands, narrow = [], []
    for wide in sorted({s.bit_length() - 1 for s, _ in sizes}):
        own = [(s, k) for s, k in sizes if s.bit_length() - 1 == wide]
        if largest[wide] <= most:
            bands.append((own[0][0], own[-1][0], sum(k for _, k in own)))
        else:
            cut = _narrow(own, most)
            bands += cut
            narrow += [(low, high) for low, high, _ in cut]
    joined = F.lit(False)
    for low, high in narrow:
        joined = joined | F.col("su").between(low, high)
    return placed.withColumn("comp", F.when(joined, F.lit(0).cast("long")).otherwise(F.col("comp"))), bands


def solve(weighted: DataFrame, roots: DataFrame, n: int, one_task: int = ONE_TASK) -> DataFrame:
    """u, a, b, score, in_tree: each cluster's best split and total, and whether it is part of a tree of ``roots`` (mask).

    A cluster of two taxa or fewer scores 0, and so does a part that no candidate divides; such a part of the tree is
    an error. Of equal totals, the split with the smallest sets is taken. Clusters are solved by ascending size, band
    by band. When a band is solved, the totals of its clusters are sent, as messages by the number of the candidate, to
    the bands of the candidates that have them as parts; a band reads its own candidates and messages only, so each
    candidate and message is read once. Bands are as many as sizes double, if clusters that nest in each other within a
    band are few enough for a task; what nests more is cut into bands of so many candidates, or of one size, which all
    tasks solve.
    """
    spark = weighted.sparkSession
    options = candidates(weighted, n).withColumn("su", bits.size("u", n)).withColumn("id", F.monotonically_increasing_id())
    options = settle(options, "options")
    sizes = [tuple(r) for r in options.groupBy("su").count().orderBy("su").collect()]  # a row for each size
    options, bands = _plan(options, sizes, n, one_task)
    kind = bits.kind(n)
    schema = f"u {kind}, a {kind}, b {kind}, su long, score long, comp long"
    solved, sent, kept, named = (folder(spark, x) for x in ("solved", "messages", "by-band", "parts"))
    if len(bands) > 1:
        of_size = F.broadcast(spark.createDataFrame([(s, next(i for i, (low, high, _) in enumerate(bands) if low <= s <= high)) for s, _ in sizes], "size long, band int"))
        options = options.join(of_size.withColumnRenamed("size", "su"), "su")
        options.write.partitionBy("band").parquet(kept)
        by_band = spark.read.parquet(kept)
        parts = by_band.select("id", F.col("band").alias("to"), F.explode(F.array("a", "b")).alias("part"))
        parts = parts.withColumn("size", bits.size("part", n)).where("size > 2").join(of_size, "size").where("band < to")
        parts.select("part", "id", "to", "band").write.partitionBy("band").parquet(named)
        parts = spark.read.schema(f"part {kind}, id long, to int, band int").parquet(named)
    for k, (low, high, size) in enumerate(bands):
        own = by_band.where(F.col("band") == k) if len(bands) > 1 else options
        if k:
            messages = spark.read.schema("id long, value long, from int, to int").parquet(sent).where(F.col("to") == k)
            own = own.join(messages.groupBy("id").agg(F.sum("value").alias("below")), "id", "left")
        else:
            own = own.withColumn("below", F.lit(0).cast("long"))
        own = own.select("u", "a", "b", "su", "weight", F.coalesce("below", F.lit(0).cast("long")).alias("below"), "comp")
        if low == high and size > one_task:
            total = F.when(F.col("su") > 2, F.col("weight") + F.col("below")).otherwise(F.lit(0))
            best = own.withColumn("score", total).groupBy("u").agg(F.min_by(F.struct("a", "b", "su", "score", "comp"), F.struct(-F.col("score"), "a", "b")).alias("x")).select("u", "x.*")
        else:
            best = own.repartition("comp").mapInArrow(_band, schema)
        best.write.parquet(f"{solved}/band={k}")
        if k + 1 < len(bands):
            done = spark.read.schema(schema).parquet(f"{solved}/band={k}").where("score > 0").select(F.col("u").alias("part"), F.col("score").alias("value"))
            out = parts.where(F.col("band") == k).join(done, "part").select("id", "value", "to")
            out.repartition("to").write.partitionBy("to").parquet(f"{sent}/from={k}")
    done = spark.read.schema(schema + ", band int").parquet(solved) if bands else spark.createDataFrame([], schema + ", band int")
    tree = _follow(done, roots, [(low, high) for low, high, _ in bands], n)
    return done.join(tree.select("u", F.lit(True).alias("in_tree")), "u", "left").select("u", "a", "b", "score", F.coalesce("in_tree", F.lit(False)).alias("in_tree"))


def _chosen(rows):
    """Of a task's clusters, the wanted ones and the parts of these that are there, the largest first."""
    import pyarrow as pa

    key = lambda m: tuple(m.values())
    found: dict[tuple, tuple] = {}
    wanted: set[tuple] = set()
    for batch in rows:
        for u, a, b, su, asked in zip(*(batch.column(c).to_pylist() for c in ("u", "a", "b", "su", "asked")), strict=True):
            found[key(u)] = (u, a, b, su)
            if asked:
                wanted.add(key(u))
    out = []
    for u, row in sorted(found.items(), key=lambda x: -x[1][3]):
        if u in wanted:
            out.append(row)
            wanted |= {key(row[1]), key(row[2])}
    kind = pa.struct([(k, pa.int64()) for k in next((r[0] for r in found.values()), {"w0": 0})])
    yield pa.record_batch([pa.array([r[i] for r in out], kind) for i in range(3)], names=["u", "a", "b"])


def _follow(done: DataFrame, roots: DataFrame, bands: list[tuple[int, int]], n: int) -> DataFrame:
    """u, a, b of the clusters of the trees below ``roots``, the bands of sizes from the greatest down; of a band, what nests with a wanted cluster."""
    spark, schema, path = done.sparkSession, f"u {bits.kind(n)}, a {bits.kind(n)}, b {bits.kind(n)}", folder(done.sparkSession, "tree")
    every = wanted = roots.select(F.col("mask").alias("u"))
    tree = spark.createDataFrame([], schema)
    for k, (low, high) in reversed(list(enumerate(bands))):
        asked = every.where(bits.size("u", n).between(low, high)).distinct().withColumn("asked", F.lit(True))
        own = done.where(F.col("band") == k).join(asked, "u", "left")
        if low == high:
            own = own.where("asked").select("u", "a", "b")
        else:
            touched = done.where(F.col("band") == k).join(asked, "u").select("comp").distinct()
            own = own.join(touched, "comp", "left_semi").select("u", "a", "b", "su", F.coalesce("asked", F.lit(False)).alias("asked"), "comp")
            own = own.repartition("comp").drop("comp").mapInArrow(_chosen, schema)
        own.write.parquet(f"{path}/band={k}")
        tree = spark.read.schema(schema).parquet(f"{path}/band=*")  # as many rows as the trees have nodes
        every = wanted.union(tree.select(F.explode(F.array("a", "b")).alias("u")))
    open_parts = every.where(bits.size("u", n) > 1).join(tree.select("u"), "u", "left_anti")
    if not open_parts.isEmpty():
        raise ValueError("no candidate split for a cluster of the tree")
    return tree


def _emit(rows):
    import pyarrow as pa

    key = lambda m: tuple(m.values())
    splits, parts = {}, set()
    for u, a, b, left, right, note, length in zip(*(rows[c].to_pylist() for c in ("u", "a", "b", "left", "right", "note", "length")), strict=True):
        after = f":{length:.6f}" if length and length > 0 and ":" not in (note or "") else ""
        splits[key(u)] = (key(a), key(b), left, right, (note or "") + after)
        parts |= {key(a), key(b)}
    done: dict[tuple, tuple[str, str]] = {}  # set -> (smallest label, text)
    open_sets = [u for u in splits if u not in parts]
    top = open_sets[0]
    while open_sets:
        u = open_sets[-1]
        a, b, left, right, note = splits[u]
        if later := [x for x, label in ((a, left), (b, right)) if label is None and x not in done]:
            open_sets += later
            continue
        open_sets.pop()
        (first, x), (second, y) = sorted([(left, left) if left is not None else done[a], (right, right) if right is not None else done[b]])
        done[u] = (first, f"({x},{y}){note}")
    return pa.table({"tree_id": rows["tree_id"][:1], "newick": pa.array([done[top][1] + ";"])})


def newick(trees: DataFrame, taxa: DataFrame, n: int) -> DataFrame:
    """tree_id, newick from rows (tree_id, u, a, b, note) of each tree's splits; note is text after a node, or null.

    With a column length, it follows the note with six decimals, if it is above 0 and the note has no colon. Of two
    parts, the one with the smaller label comes first. Labels are joined to the leaves; a task writes a whole tree.
    """
    length = F.col("length").cast("double") if "length" in trees.columns else F.lit(None).cast("double")
    rows = trees.select("tree_id", "u", "a", "b", "note", length.alias("length"))
    for part, name in (("a", "left"), ("b", "right")):
        rows = rows.join(taxa.select(bits.key(bits.singleton(F.col("taxon"), n)).alias(part), F.col("label").alias(name)), part, "left")
    kind = dict(trees.dtypes)["tree_id"]
    return rows.select("tree_id", "u", "a", "b", "left", "right", "note", "length").groupBy("tree_id").applyInArrow(_emit, f"tree_id {kind}, newick string")

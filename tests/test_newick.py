"""Reading, parsing and writing trees."""

import math
import os
import random
import re

import pytest

from cladeworks import session
from cladeworks.jobs.trees import Collection, Options, infer_species_tree
from cladeworks.sources import newick, stats
from pyspark.sql import functions as F
from tests import windowed

CASES = [
    ("((A,B),C);", "ok"), ("A;", "ok"), ("(A,B,C);", "not_binary"), ("((A),B);", "not_binary"), ("((A,B),C;", "unbalanced"), ("((A,B)0.95:0.1,C);", "ok"), ("((A,A),B);", "duplicate"), ("[&R] ((A,B),C);", "ok"),
    ("((A:1.8e-06,B:2),C);", "ok"), ("(A,B);(C,D);", "unbalanced"), ("(A,C);", "ok"), ("((A,B),C)", "ok"), ("(A,);", "label"), ("(,);", "label"), ("();", "label"), ("A(B,C);", "unbalanced"), ("(A,B)),C);", "unbalanced"), (")(", "label"),
    ("(A,B)(C,D);", "unbalanced"), ("((A,B)(C,D));", "not_binary"), (" ( ( A , B ) , C ) ; ", "ok"), ("A,B;", "unbalanced"), (";", "label"), ("((A,B),(C,D))x;", "ok"), ("A;B", "unbalanced"),
]


def test_status(spark):
    df = spark.createDataFrame([*((i, t) for i, (t, _) in enumerate(CASES)), (98, "   "), (99, None)], "tree_id long, newick string")
    got = {r.tree_id: r.status for r in newick.parse(df).status.collect()}
    assert {CASES[i][0]: s for i, s in got.items()} == dict(CASES)
    strict = {r.tree_id: r.status for r in newick.parse(df, "reject").status.collect()}
    assert strict[5] == "label" and strict[0] == "ok"


def test_parse_as_by_windows(spark):
    """Random lines, most of them with a fault, have the status, leaves and nodes that windows over tokens give them."""
    rng = random.Random(11)
    texts = ["".join(rng.choice(("(", ")", ",", ";", "A", "B", "Ünï", "C", "(A,B)", "((A,B),C)", ":0.1", "[x]", " ")) for _ in range(rng.randint(1, 14))) for _ in range(300)]
    for _ in range(60):
        parts = [f"t{i}" for i in range(rng.randint(2, 40))]
        while len(parts) > 1:
            rng.shuffle(parts)
            parts.append(f"({parts.pop()},{parts.pop()})")
        t = parts[0] + ";"
        texts += [f"({t[:-1]},t1);", t, t.replace(rng.choice("(),"), "", 1), t.replace(",", ",(", 1), t.replace(")", ")0.5", 2)]
    df = spark.createDataFrame(list(enumerate(texts)), "tree_id long, newick string")
    for internal in ("ignore", "reject"):
        got, (tokens, status) = newick.parse(df, internal), windowed.parse(df, internal)
        want = sorted(map(tuple, status.collect()))
        assert sorted(map(tuple, got.status.select("tree_id", "status", "n_leaves").collect())) == want and len({s for _, s, _ in want}) == 5
        labels = {r.tree_id: r.labels for r in got.trees.collect()}
        for t, pos, tok in tokens.where("leaf").select("tree_id", F.col("leaves") - 1, "tok").collect():
            assert labels[t][pos] == tok
        spot = lambda k: F.max(F.when(F.col("tok") == k, F.col("leaves")))
        nodes = tokens.where("tok in ('(', ',', ')')").groupBy("tree_id", "depth", "node").agg(spot("(").alias("s"), spot(",").alias("m"), spot(")").alias("e"))
        spans = [(r.tree_id, *x) for r in got.trees.collect() for x in zip(r.start, r.mid, r.end, strict=True)]
        assert sorted(spans) == sorted((r.tree_id, r.s, r.m, r.e) for r in nodes.collect())


def test_parse_needs_no_shuffle(spark):
    """From lines to nodes there is no exchange, and a long line is parsed as one."""
    n = 20_000
    line = "(" * (n - 1) + "t0" + "".join(f",t{i})" for i in range(1, n)) + ";"
    found = newick.parse(spark.createDataFrame([(1, line)], "tree_id long, newick string"))
    assert "Exchange" not in found.trees._jdf.queryExecution().toString()
    row = found.trees.first()
    assert row.labels == [f"t{i}" for i in range(n)] and sorted(row.end) == list(range(2, n + 1)) and set(row.start) == {0}


def test_files(spark, tmp_path):
    for folder, n in (("01", 3), ("02", 11)):
        (tmp_path / folder).mkdir()
        for i in range(1, n):
            (tmp_path / folder / f"g_trees{i:02d}.trees").write_text(f"[&R] ((A_0_0:1,\nB_0_0:{i}),C_0_0)\r\n")
        (tmp_path / folder / "other.txt").write_text("x")
    got = newick.read_tree_files(spark, str(tmp_path)).withColumn("newick", newick.drop_label_suffix(F.col("newick"))).orderBy("replicate", "tree_id").collect()
    assert [(r.replicate, r.tree_id) for r in got] == [("1", 1), ("1", 2), *(("2", i) for i in range(1, 11))]
    assert got[0].newick == "((A:1,B:1),C);"
    text = tmp_path / "trees.txt"
    text.write_text("\n((A,B),C);\n\nbad\n(A,(B,C));\n")
    assert [r.newick for r in newick.read_lines(spark, str(text)).orderBy("tree_id").collect()] == ["((A,B),C);", "bad", "(A,(B,C));"]
    assert newick.read_lines(spark, str(text), first=2).count() == 2
    out = f"{tmp_path}/out"
    newick.write_newick(spark.createDataFrame([("((A,B),C);",)], "newick string"), out)
    newick.write_newick(spark.createDataFrame([("other",)], "newick string"), out, mode="ignore")
    assert [r.value for r in spark.read.text(out).collect()] == ["((A,B),C);"]


def test_stats(spark, tmp_path):
    row = spark.createDataFrame([tuple(map(str, range(len(stats.DISCORDANCE))))], list(stats.DISCORDANCE)).withColumn("more", F.lit(1))
    for _ in range(2):
        stats.write(row, f"{tmp_path}/s", stats.DISCORDANCE, "append")
    assert spark.read.option("header", True).csv(f"{tmp_path}/s").count() == 2
    with pytest.raises(Exception):
        stats.write(row, f"{tmp_path}/r", stats.RUN)


def test_streaming(spark, tmp_path):
    """Counts go on after a restart, a batch that runs again changes nothing, and merging batches does not, either."""
    from cladeworks.streaming import split_counts

    taxa = spark.createDataFrame([(i, c) for i, c in enumerate("ABC")], "taxon long, label string")
    folder, out, check = tmp_path / "in", f"{tmp_path}/out", tmp_path / "check"
    folder.mkdir()
    run = lambda: split_counts.start(spark, str(folder), out, str(check), taxa, 3).awaitTermination()
    read = lambda: {(r.a.w0, r.b.w0): r.freq for r in split_counts.totals(spark, out).collect()}
    want = []
    for i, (text, total) in enumerate([("((A,B),C);\n((B,A),C);\nbad;;\n\n", {(1, 2): 2, (3, 4): 2}), ("((A,B),C);\n(A,(B,C));\n((A,X),C);\n(A,A);\n", {(1, 2): 3, (3, 4): 3, (2, 4): 1, (1, 6): 1})]):
        (folder / f"{i}.txt").write_text(text)
        run()
        want.append(total)
        assert read() == total
    for name in ("1", ".1.crc"):  # as if the driver had been lost before it noted that the last batch was over
        (check / "commits" / name).unlink(missing_ok=True)
    run()
    assert read() == want[1] and len(os.listdir(out)) == 2
    split_counts.compact(spark, f"file://{out}")
    assert read() == want[1] and os.listdir(out) == ["batch=1"]
    (folder / "2.txt").write_text("(C,(A,B));\n")
    run()
    assert read() == want[1] | {(1, 2): 4, (3, 4): 4}
    # one that broke off when the last batch was half replaced
    split_counts.totals(spark, out).write.parquet(f"{out}/_merged-2")
    for f in os.listdir(f"{out}/batch=2"):
        os.remove(f"{out}/batch=2/{f}")
    split_counts.compact(spark, f"file://{out}")
    assert read() == want[1] | {(1, 2): 4, (3, 4): 4} and os.listdir(out) == ["batch=2"]


def test_options():
    for bad in ({"internal_labels": "x"}, {"support": "x"}, {"expansion": "UPGMA"}):
        with pytest.raises(ValueError):
            Options(**bad)


def test_no_trees(spark):
    with pytest.raises(ValueError):
        infer_species_tree(spark.createDataFrame([(1, "bad;;"), (2, None)], "tree_id long, newick string")).collect()


def test_unknown_taxa(spark):
    """With a dictionary, trees with other labels are not accepted, and give no split."""
    rows = spark.createDataFrame([(1, "((A,B),C);"), (2, "((A,X),C);"), (3, "(A,C);"), (4, "((X,X),A);"), (5, "X;")], "tree_id long, newick string")
    taxa = spark.createDataFrame([(0, "A"), (1, "B"), (2, "C")], "taxon int, label string")
    trees = Collection(rows, taxa=taxa)
    assert {r.tree_id: r.status for r in trees.status.collect()} == {1: "ok", 2: "unknown", 3: "ok", 4: "unknown", 5: "unknown"}
    assert {(r.tree_id, r.left.w0, r.right.w0) for r in trees.nodes.collect()} == {(1, 3, 4), (1, 1, 2), (3, 1, 4)}
    assert Collection(rows).status.where("status = 'unknown'").count() == 0


def test_reorganize(spark, tmp_path):
    """Replicates with both files, partitioned by replicate; what is there stays."""
    for folder, names in (("01", ("all_gt.tre", "s_tree.trees")), ("2", ("all_gt.tre",)), ("10", ("all_gt.tre", "s_tree.trees")), ("x", ("all_gt.tre", "s_tree.trees"))):
        (tmp_path / "in" / folder).mkdir(parents=True)
        for name in names:
            (tmp_path / "in" / folder / name).write_text(f"((a_0_0,b_0_0),c{folder}_0_0);\n")
    assert newick.reorganize(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out") == ["R01", "R10"]
    got = {(r.replicate, r.value) for r in spark.read.text(f"file://{tmp_path}/out/all_gt").collect()}
    assert got == {("R01", "((a,b),c01);"), ("R10", "((a,b),c10);")} and (tmp_path / "in" / "2" / "all_gt.tre").exists()
    assert {r.value for r in spark.read.text(f"file://{tmp_path}/out/s_tree").collect()} == {"((a_0_0,b_0_0),c01_0_0);", "((a_0_0,b_0_0),c10_0_0);"}


def test_work_dir_off_local_mode():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Session:
        conf, sparkContext = Conf(), Context()  # noqa: N815

    with pytest.raises(ValueError):
        session.work_dir(Session())


def test_temporary(spark):
    with session.temporary(spark):
        one = session.settle(spark.range(3), "gone")
        two = session.settle(spark.range(4), path=session.folder(spark, "stays"))
        gone = one.inputFiles()[0].removeprefix("file://")
        assert os.path.exists(gone) and one.count() == 3
    assert not os.path.exists(gone) and two.count() == 4


def test_collection_of_many_trees(spark):
    """37 taxa, 60 trees that scatter around one: the inferred tree is that one, with its score by definition."""
    rng = random.Random(37)
    labels = [f"s{i:02d}" for i in range(37)]
    parts = list(labels)
    while len(parts) > 1:
        rng.shuffle(parts)
        parts.append((parts.pop(), parts.pop()))
    base = parts[0]
    text = lambda t: t if isinstance(t, str) else f"({text(t[0])},{text(t[1])})"

    def scattered():
        """Two leaves change places."""
        x, y = rng.sample(labels, 2)
        return re.sub("s[0-9]+", lambda m: {x: y, y: x}.get(m[0], m[0]), text(base))

    lines = [text(base)] * 20 + [scattered() for _ in range(40)]
    trees = Collection(spark.createDataFrame([(i, t + ";") for i, t in enumerate(lines)], "tree_id long, newick string"))
    assert (trees.status.where("status = 'ok'").count(), trees.n_taxa, trees.nodes.count()) == (60, 37, 60 * 36)
    best = infer_species_tree(trees.lines).first()
    weight = {(r.a.w0, r.b.w0): r.weight for r in trees.weights.collect()}
    own = Collection(spark.createDataFrame([(0, text(base) + ";")], "tree_id long, newick string"), taxa=trees.taxa).splits.collect()
    assert best.is_complete and best.score >= sum(weight[r.a.w0, r.b.w0] for r in own) and best.score <= 60 * math.comb(37, 3)
    again = Collection(spark.createDataFrame([(0, best.newick)], "tree_id long, newick string"), taxa=trees.taxa).splits.collect()
    assert {(r.a, r.b) for r in again} == {(r.a, r.b) for r in own}

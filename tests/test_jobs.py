"""The scripts, and a collection with known values."""

import os

import pytest
from pyspark.sql import functions as F

from cladeworks.jobs import evaluate, infer
from cladeworks.jobs import trees as jobs
from cladeworks.jobs.trees import Collection, species_tree
from cladeworks.operators import splits
from cladeworks.sources import newick

GOLDEN = f"file://{os.path.dirname(os.path.abspath(__file__))}/golden.tre"
#: Values of that file by a plain program: 40 good lines of up to 24 taxa and three bad ones.
OCCURRENCES, DISTINCT, MOST, CLUSTERS, GREATEST_WEIGHT, SCORE, TRIPLETS = 896, 97, 39, 107, 38300, 74711, 75656
TREE = "(((s00,(s07,s23)),(((((s01,s13),(s04,(s05,s15))),(s02,(s06,(s10,s22)))),((s09,((s11,s21),s18)),s19)),(((s03,s17),s20),s14))),((s08,s12),s16));"


@pytest.mark.parametrize("masked", [630, 5])
def test_golden(spark, monkeypatch, masked):
    """The known values, with sets of members and with hashed ones."""
    monkeypatch.setattr(jobs, "MASKED", masked)
    c = Collection(newick.read_lines(spark, GOLDEN))
    assert {r.status: r["count"] for r in c.status.groupBy("status").count().collect()} == {"ok": 40, "unbalanced": 1, "duplicate": 1, "not_binary": 1}
    assert (c.n_taxa, c.nodes.count(), c.splits.count(), c.splits.agg(F.max("freq")).first()[0]) == (24, OCCURRENCES, DISTINCT, MOST)
    assert splits.clusters(c.splits, c.words).count() == CLUSTERS
    assert tuple(c.weights.agg(F.min("weight"), F.max("weight")).first()) == (0, GREATEST_WEIGHT)
    found = species_tree(c).first()
    assert (found.newick, found.score, found.n_trees, found.is_complete) == (TREE, SCORE, 40, True) and SCORE <= TRIPLETS
    assert c.collisions.isEmpty()


def csv(spark, path):
    return [r.asDict() for r in spark.read.option("header", True).csv(path).collect()]


def test_infer(spark, tmp_path, capsys):
    """The script's tree, and its report of lines left out."""
    infer.main([GOLDEN, f"{tmp_path}/out", "--report", f"{tmp_path}/report", "--verify", "--support", "posterior"])
    assert "left out 3 of 43 lines: 1 duplicate, 1 not_binary, 1 unbalanced" in capsys.readouterr().err
    text = spark.read.text(f"{tmp_path}/out").first().value
    assert text.count(",") == 23 and ")1" in text
    assert {(r["status"], r["newick"]) for r in csv(spark, f"{tmp_path}/report/skipped")} == {("unbalanced", "((s00,s01),(s02,s03);"), ("duplicate", "(s00,s00);"), ("not_binary", "(s00,s01,s02);")}
    assert {r["status"]: r["n_lines"] for r in csv(spark, f"{tmp_path}/report/status")}["ok"] == "40"
    assert [(r["algorithm"], r["input_file"], r["exit_code"]) for r in csv(spark, f"{tmp_path}/report/run")] == [("triplets", GOLDEN, "0")]


def test_evaluate(spark, tmp_path, capsys):
    """Topologies, distances and discordance from files."""
    for name, text in (("a", "((x,y),(z,(v,w)));"), ("b", "\n(((w,v),z),(y,x))\n"), ("c", "((x,z),(y,(v,w)));"), ("bad", "((x,y);"), ("small", "((x,y),z);")):
        (tmp_path / name).write_text(text)
    at = lambda *names: [f"file://{tmp_path}/{n}" for n in names]
    assert evaluate.main(["same", *at("a", "b")]) == 0 and evaluate.main(["same", *at("a", "c")]) == 1 and evaluate.main(["same", *at("a", "small")]) == 1
    evaluate.main(["distances", *at("a", "b", "c"), "--output", f"{tmp_path}/rf"])
    got = [(r["tree_1"][-1], r["tree_2"][-1], r["distance"], r["rf"], r["similarity_pct"]) for r in csv(spark, f"{tmp_path}/rf")]
    assert got == [("a", "b", "0", "0.0", "100.0"), ("a", "c", "2", "0.5", "50.0"), ("b", "c", "2", "0.5", "50.0")]
    with pytest.raises(ValueError, match="bad"):
        evaluate.main(["distances", *at("a", "bad")])
    with pytest.raises(SystemExit):
        evaluate.main(["distances", *at("a")])
    capsys.readouterr()
    assert evaluate.main(["dataset", GOLDEN, GOLDEN, "--max-trees", "3"]) == 0
    assert "n_pairs=3" in capsys.readouterr().out

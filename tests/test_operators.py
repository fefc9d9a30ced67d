"""Weights, species trees, quartets, support and distances against brute force on random trees."""

import ast
import itertools
import math
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from cladeworks.functions import bits, support
from cladeworks.jobs import reports
from cladeworks.jobs import trees as jobs
from cladeworks.jobs.trees import Collection, Options, infer_species_tree
from cladeworks.operators import ancestry, compare, dp, orders, quartets, splits, weights
from cladeworks.operators.components import components
from cladeworks.session import temporary, work_dir
from cladeworks.sources import stats


def random_tree(rng, labels):
    """Nested pairs."""
    parts = list(labels)
    while len(parts) > 1:
        rng.shuffle(parts)
        parts.append((parts.pop(), parts.pop()))
    return parts[0]


def text(t):
    return t if isinstance(t, str) else f"({text(t[0])},{text(t[1])})"


def leaves(t):
    return {t} if isinstance(t, str) else leaves(t[0]) | leaves(t[1])


def nodes(t):
    if isinstance(t, str):
        return []
    return [(leaves(t[0]), leaves(t[1])), *nodes(t[0]), *nodes(t[1])]


def triplet(t, three):
    """The pair of three leaves that is closest, or None."""
    for x, y in nodes(t):
        for near, far in ((x, y), (y, x)):
            if len(near & three) == 2 and len(far & three) == 1:
                return frozenset(near & three)
    return None


def lines(spark, trees):
    return spark.createDataFrame([(i, text(t) + ";") for i, t in enumerate(trees)], "tree_id long, newick string")


LABELS = [f"t{i:03d}" for i in range(200)]


def words_of(names, n):
    total = sum(1 << LABELS.index(x) for x in names)
    return tuple(total >> 63 * i & (1 << 63) - 1 for i in range(n))


@pytest.fixture(scope="module")
def collection(spark):
    rng = random.Random(1)
    base = random_tree(rng, LABELS[:9])
    trees = [base] * 4 + [random_tree(rng, LABELS[:9]) for _ in range(6)] + [random_tree(rng, LABELS[2:8]) for _ in range(3)]
    return trees, Collection(lines(spark, trees))


def test_weights_count_triplets(collection):
    """The weights of a tree's own splits sum to the triplets of all gene trees that it agrees with."""
    trees, c = collection
    got = {(tuple(r.a), tuple(r.b)): r.weight for r in c.weights.collect()}
    for t in trees:
        total = sum(got[tuple(sorted((words_of(x, 1), words_of(y, 1))))] for x, y in nodes(t))
        three = [frozenset(x) for x in itertools.combinations(sorted(leaves(t)), 3)]
        assert total == sum(triplet(g, x) == triplet(t, x) is not None for g in trees for x in three)


def brute_best(options):
    """The best total of every cluster, by recursion over candidate splits."""
    memo = {}

    def best(u):
        if u.bit_count() <= 2 or u not in options:
            return 0
        if u not in memo:
            memo[u] = max(w + best(a) + best(b) for w, a, b in options[u])
        return memo[u]

    return {u: best(u) for u in options}


@pytest.mark.parametrize("one_task", [0, 20, 45, 60, 10**6])
def test_species_tree(collection, one_task):
    trees, c = collection
    options = {}
    for r in c.weights.collect():
        options.setdefault(r.a.w0 | r.b.w0, []).append((r.weight, r.a.w0, r.b.w0))
    got = dp.solve(c.weights, c.root, c.words, one_task=one_task).collect()
    assert {r.u.w0: r.score for r in got} == brute_best(options)
    tree = [r for r in got if r.in_tree]
    assert len(tree) == 8 and max(r.score for r in tree) == max(r.score for r in got)
    weight = {(a, b): w for o in options.values() for w, a, b in o}
    assert sum(weight[r.a.w0, r.b.w0] for r in tree if r.u.w0.bit_count() > 2) == max(r.score for r in tree)


def test_order_does_not_matter(spark, collection):
    trees, _ = collection
    flip = lambda t: t if isinstance(t, str) else (flip(t[1]), flip(t[0]))
    one, two = (infer_species_tree(lines(spark, x)).first() for x in (trees, [flip(t) for t in trees[:10][::-1]] + trees[10:]))
    assert one == two


def test_same_trees_agree_wholly(spark):
    t = random_tree(random.Random(2), LABELS[:8])
    found = infer_species_tree(lines(spark, [t] * 5)).first()
    assert found.score == 5 * math.comb(8, 3) and found.is_complete and found.n_trees == 5


def test_many_taxa(spark):
    """Sets of more than one word, and the weights from leaf orders."""
    rng = random.Random(3)
    trees = [random_tree(rng, LABELS[: rng.choice([130, 150])]) for _ in range(6)]
    c = Collection(lines(spark, trees))
    assert c.words == 3 and c.n_taxa == 150
    want = {}
    score = lambda p, q: p * q * (p + q - 2) // 2
    every = [x for t in trees for x in nodes(t)]
    for x, y in every:
        a, b = sorted((words_of(x, 3), words_of(y, 3)))
        want[a, b] = sum(score(len(x & l), len(y & r)) + score(len(x & r), len(y & l)) for l, r in every)
    assert {(tuple(r.a), tuple(r.b)): r.weight for r in c.weights.collect()} == want
    rows = [(i, [LABELS.index(v) for v in x], [LABELS.index(v) for v in y]) for i, (x, y) in enumerate(every)]
    cand = spark.createDataFrame(rows, "id long, left array<int>, right array<int>")
    got = {r.id: r.weight for r in weights.weights_by_order(cand, weights.tree_arrays(c.order, c.nodes)).collect()}
    assert all(got[i] == want[tuple(sorted((words_of(x, 3), words_of(y, 3))))] for i, (x, y) in enumerate(every))
    best = infer_species_tree(c.lines).first()
    assert best.newick.count(",") == 149


def test_hashed_sets(spark, monkeypatch):
    """The way for many taxa: sets known by hashes, weights along leaf orders; the same weights, scores, trees and distances."""
    rng = random.Random(21)
    base = random_tree(rng, LABELS[:40])
    trees = [base] * 5 + [random_tree(rng, LABELS[: rng.choice([30, 40])]) for _ in range(5)]
    one = Collection(lines(spark, trees))
    assert one.words == 1 and not one.by_order
    monkeypatch.setattr(jobs, "MASKED", 10)
    two = Collection(one.lines, taxa=one.taxa)
    assert two.words == bits.HASHED and two.by_order
    weight = lambda c: sorted((r.freq, r.weight) for r in c.splits.join(c.weights, ["a", "b"]).collect())
    assert weight(one) == weight(two) and one.splits.count() == two.splits.count()
    scores = lambda c: sorted(r.score for r in c.solved.collect())
    assert scores(one) == scores(two)
    found = infer_species_tree(one.lines).first()
    monkeypatch.undo()
    want = infer_species_tree(one.lines).first()
    assert (found.score, found.is_complete) == (want.score, want.is_complete) and found.newick.count(",") == 39
    whole = {i for i, t in enumerate(trees) if len(leaves(t)) == 40}  # which side is the smaller one depends on the form of sets
    pairs = lambda c: {(r.tree_1, r.tree_2): r.distance for r in compare.all_pairs(compare.unrooted(c.nodes, c.words), c.nodes).collect() if {r.tree_1, r.tree_2} <= whole}
    assert pairs(one) == pairs(two)


def test_support_along_orders(spark, monkeypatch):
    """Quartets along leaf orders are those from sets: trees that lack taxa, a species tree that does, leaves as siblings."""
    rng = random.Random(22)
    caterpillar = LABELS[0]
    for x in LABELS[1:17]:
        caterpillar = (caterpillar, x)
    trees = [random_tree(rng, LABELS[:16]), caterpillar, *(random_tree(rng, rng.sample(LABELS[:18], rng.randint(6, 18))) for _ in range(12))]
    one = Collection(lines(spark, trees))
    assert one.words == 1
    monkeypatch.setattr(jobs, "MASKED", 10)
    two = Collection(one.lines, taxa=one.taxa)
    assert two.words == bits.HASHED
    for k in (0, 1):
        tree = lambda c: c.nodes.where(F.col("tree_id") == k).select(bits.union("left", "right", c.words).alias("u"), F.least("left", "right").alias("a"), F.greatest("left", "right").alias("b"))  # noqa: B023, E731
        rows = lambda c: c.branches(tree(c)).collect()  # noqa: B023, E731
        plain = lambda found, size: sorted((size(r.branch), int(r.f1), *sorted((int(r.f2), int(r.f3))), int(r.n), int(r.possible), round(r.posterior or 0, 9), round(r.p_value or -1, 9)) for r in found)
        want, got = rows(one), rows(two)
        assert plain(want, lambda u: u.w0.bit_count()) == plain(got, lambda u: u.w2) and len(want) > 8
    for kind in ("all", "both"):
        found = infer_species_tree(one.lines, Options(support=kind)).first()
        assert found.newick.count(",") >= 16 and "pp=" in found.newick or kind == "both"


def test_weights_along_orders_when_splits_differ(spark):
    """Sets of several words, and splits too many to meet each other: the same weights."""
    rng = random.Random(22)
    trees = [random_tree(rng, LABELS[:70]) for _ in range(4)]
    c = Collection(lines(spark, trees))
    by_order = weights.weights_by_ranges(c.splits, weights.tree_arrays(c.order, c.nodes))
    by_sets = weights.weights(c.splits, c.splits, c.words)
    as_dict = lambda df: {(tuple(r.a), tuple(r.b)): r.weight for r in df.collect()}
    assert as_dict(by_order) == as_dict(by_sets)


def test_undivided_cluster_is_an_error(spark):
    kind = "a struct<w0:bigint>, b struct<w0:bigint>, weight long"
    weighted = spark.createDataFrame([((3,), (12,), 5), ((1,), (2,), 0)], kind)
    root = spark.createDataFrame([((15,),)], "mask struct<w0:bigint>")
    for one_task in (0, 100):
        with pytest.raises(ValueError):
            dp.solve(weighted, root, 1, one_task).collect()


def test_score_of_the_tree_that_is_written(spark, collection):
    """The tree parsed back from its text has the total score, and its branches have lengths."""
    trees, c = collection
    found = infer_species_tree(c.lines).first()
    again = Collection(spark.createDataFrame([(0, found.newick)], "tree_id long, newick string"), taxa=c.taxa)
    weight = {(tuple(r.a), tuple(r.b)): r.weight for r in c.weights.collect()}
    assert sum(weight[tuple(r.a), tuple(r.b)] for r in again.splits.collect()) == found.score
    plain, with_length, both = (infer_species_tree(c.lines, Options(support=k)).first().newick for k in ("posterior", "length", "both"))
    assert len(re.findall(r"\)[0-9.]+:[0-9]+[.][0-9]{6}", plain)) >= 1 and len(re.findall(r"\)[0-9.]+:[0-9]+[.][0-9]{6}", with_length)) >= 1
    assert not re.findall(r":[0-9.]+:", both) and re.findall(r"\)[0-9.]+:[0-9.]+", both)


def test_reports(spark, collection, tmp_path):
    trees, c = collection
    species = lines(spark, [trees[0]])
    row = reports.dataset_discordance(c.lines, species, 6).first()
    pairs = list(itertools.combinations(trees[:6], 2))
    n = len(set().union(*map(leaves, trees[:6])))
    norm = lambda x: min(1, x / (2 * (n - 3)))
    assert row.n_pairs == 15 and row.n_trees == 6 and row.gene_gene == pytest.approx(sum(norm(plain_rf(*x)) for x in pairs) / 15, abs=1e-6)
    assert row.gene_species == pytest.approx(sum(norm(plain_rf(t, trees[0])) for t in trees[:6]) / 6, abs=1e-6)
    for bad in ((species, 0), (spark.createDataFrame([(0, "((a,b);")], "tree_id long, newick string"), 5)):
        with pytest.raises(ValueError):
            reports.dataset_discordance(c.lines, *bad)
    found, record = reports.benchmark_record(spark, c.lines, species, "R1")
    assert tuple(record.columns) == stats.BENCHMARK
    stats.write(record, f"file://{tmp_path}/stat", stats.BENCHMARK)
    back = spark.read.option("header", True).csv(f"file://{tmp_path}/stat").first()
    assert float(back["rf-rate"]) == pytest.approx(plain_rf(trees[0], parsed(found.first().newick)) / (2 * (9 - 3)), abs=1e-6) and back["gene-trees"] == "13" and back["num-taxa"] == "9"
    text = spark.createDataFrame([("none here",), ("RF is 0.25 of 12\nlast line: a b 7",), (None,)], "t string").select(stats.first_number(F.col("t")), stats.last_field(F.col("t"), "last line:")).collect()
    assert [tuple(r) for r in text] == [(None, None), ("0.25", "7"), (None, None)]


def parsed(newick):
    """Nested pairs of a plain Newick text."""
    return ast.literal_eval(re.sub(r"([^(),;]+)", r"'\1'", newick.rstrip(";")))


def quartet_of(t, a, b, c, d):
    """1 for ab|cd, 2 for ac|bd, 3 for ad|bc where a node has two of the four on either side; else 0."""
    for x, y in nodes(t):
        if len(x & {a, b, c, d}) == 2 and len(y & {a, b, c, d}) == 2:
            mate = next(v for v in (b, c, d) if (v in x) == (a in x))
            return {b: 1, c: 2, d: 3}[mate]
    return 0


def test_quartets(spark, collection):
    trees, c = collection
    species = trees[0]
    own = [(words_of(x | y, 1), words_of(x, 1), words_of(y, 1)) for x, y in nodes(species)]
    tree = spark.createDataFrame(own, "u struct<w0:long>, a struct<w0:long>, b struct<w0:long>")
    got = {r.branch.w0: r for r in c.branches(tree).collect()}
    every, seen = leaves(species), 0

    def walk(t):
        nonlocal seen
        if isinstance(t, str):
            return
        for v, sibling in ((t[0], t[1]), (t[1], t[0])):
            if isinstance(v, str):
                continue
            q3, q4 = (leaves(sibling), every - leaves(v) - leaves(sibling)) if isinstance(sibling, str) else map(leaves, sibling)
            if q4:
                counts = [0] * 4
                for g in trees:
                    sets = [s & leaves(g) for s in (*map(leaves, v), q3, q4)]
                    for four in itertools.product(*sets):
                        counts[quartet_of(g, *four)] += 1
                r = got[words_of(leaves(v), 1)[0]]
                assert r.n == sum(counts) and r.f1 == counts[1] and sorted((r.f2, r.f3)) == sorted(counts[2:])
                assert r.length == pytest.approx(-math.log(1.5 * (1 - r.f1 / (r.n + 1))) if r.f1 / (r.n + 1) > 1 / 3 else 0)
                assert r.posterior == pytest.approx(support.posterior_of(r.f1, r.f2, r.f3, r.n, 0.5))
                seen += 1
            walk(v)

    walk(species)
    assert seen == len(got) > 3
    checked = quartets.checks(spark.createDataFrame([(1, 1, 1, 3, 4), (-1, 0, 0, 2, 1)], "f1 long, f2 long, f3 long, n long, possible long")).first()
    assert tuple(checked) == (1, 0, 1, 1)


def test_posterior():
    tail = lambda x, n: sum(math.comb(n + 1, i) * 2 ** (n + 1 - i) for i in range(x + 1)) / 3 ** (n + 1)
    for n in (1, 7, 40):
        for f1 in range(n + 1):
            assert 1 - support.incomplete_beta(1 / 3, f1 + 1, n - f1 + 1) == pytest.approx(tail(f1, n), abs=1e-12)
            assert support.incomplete_beta(2 / 3, n - f1 + 1, f1 + 1) == pytest.approx(tail(f1, n), rel=1e-9)
    assert support.posterior_of(0, 0, 0, 9, 0.5) == pytest.approx(1 / 3)
    assert support.posterior_of(90, 5, 5, 100, 0.5) > 0.999 and support.posterior_of(5, 90, 5, 100, 0.5) < 1e-6
    assert 0 <= support.posterior_of(333_400, 333_300, 333_300, 10**6, 0.5) <= 1
    assert support.posterior_of(10**6, 0, 0, 10**6, 0.01) == pytest.approx(1)


def test_annotations(spark):
    row = spark.createDataFrame([(0.5, 1.0, 0.12341, 3, 4, 5, 20), (0.12344, 0.0, None, 1, 1, 1, 3)], "pp double, bl double, pv double, f1 long, f2 long, f3 long, n long")
    f = [F.col(c) for c in ("f1", "f2", "f3")]
    note = lambda kind: [r[0] for r in row.select(support.annotation(kind, F.col("pp"), F.col("bl"), F.col("pv"), f, F.col("n"))).collect()]
    assert note("posterior") == ["0.5", "0.1234"] and note("length") == ["1", "0"] and note("both") == ["0.5:1", "0.1234:0"] and note("pvalue") == ["0.1234", "NA"]
    assert note("detailed")[0] == "'[pp=0.5000;f1=3.0;f2=4.0;f3=5.0;EN=20.0]'"
    assert note("all")[1] == "'[pp=0.1234;bl=0.0000;f1=1.0;f2=1.0;f3=1.0;EN=3.0;pval=NaN]'"
    p = spark.createDataFrame([(10, 10, 10, 30), (30, 0, 0, 30), (5, 5, 5, 15)], "a long, b long, c long, n long").select(support.p_value(*map(F.col, "abcn"))).collect()
    assert p[0][0] == 1 and p[1][0] == pytest.approx(math.exp(-30)) and p[2][0] is None


def plain_rf(s, t):
    def splits(t):
        every = leaves(t)
        return {frozenset((frozenset(x | y), frozenset(every - x - y))) for x, y in nodes(t) if 1 < len(x | y) < len(every) - 1}

    return len(splits(s) ^ splits(t))


def test_distances(spark, collection):
    trees, c = collection
    edges = compare.unrooted(c.nodes, 1)
    got = {(r.tree_1, r.tree_2): r.distance for r in compare.all_pairs(edges, c.nodes).collect()}
    assert got == {(i, j): plain_rf(trees[i], trees[j]) for i in range(len(trees)) for j in range(i + 1, len(trees))}
    assert got[0, 1] == 0 and all(got[0, j] <= got[0, k] + got[min(j, k), max(j, k)] for j in range(4, 10) for k in range(4, 10) if j != k)
    one = {r.tree_id: r.distance for r in compare.to_one(edges, c.nodes, edges.where("tree_id = 5")).collect()}
    assert one == {i: plain_rf(t, trees[5]) for i, t in enumerate(trees)}
    own = c.nodes.select("tree_id", bits.union("left", "right", 1).alias("u"))
    same = {r.tree_id for r in compare.same_topology(own, c.nodes, own.where("tree_id = 0")).collect() if r.same}
    assert same == {0, 1, 2, 3}
    n = spark.range(1).select(*(compare.normed(F.lit(d), k) for d, k in ((4, 3), (2, 5), (99, 5)))).first()
    assert tuple(n) == (0, 0.5, 1)


def test_ancestry(spark, monkeypatch, collection):
    """Depths, ancestors and lowest common nodes against intervals compared one by one, with questions dealt to several tasks."""
    _, c = collection
    monkeypatch.setattr(ancestry, "QUESTIONS", 20)
    spans = {}
    for r in c.nodes.collect():
        spans.setdefault(r.tree_id, []).append((r.start, r.end))
    holds = lambda a, b: a[0] <= b[0] and a[1] >= b[1] and a != b
    pairs = sorted((t, *v, *a) for t, all_spans in spans.items() for v in all_spans for a in all_spans if holds(a, v))
    assert sorted(map(tuple, ancestry.ancestors(c.nodes).collect())) == pairs
    assert sorted(map(tuple, ancestry.depths(c.nodes).collect())) == sorted((t, *v, sum(holds(a, v) for a in all_spans)) for t, all_spans in spans.items() for v in all_spans)
    asked = [(t, p, q) for t, all_spans in spans.items() for p in range(max(e for _, e in all_spans)) for q in range(max(e for _, e in all_spans))]
    want = {(t, p, q): min(((e - s, s, e) for s, e in spans[t] if s <= min(p, q) and e > max(p, q)))[1:] for t, p, q in asked}
    got = ancestry.lowest_common(c.nodes, spark.createDataFrame([*asked, *asked[:5]], "tree_id long, p int, q int")).collect()
    assert len(got) == len(asked) and {(r.tree_id, r.p, r.q): (r.start, r.end) for r in got} == want


def test_distances_of_many_taxa():
    """Blocks of trees with 5,000 taxa: the distances of sets, in memory that is not that of all splits for all trees."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    rng, own = np.random.default_rng(3), [set() for _ in range(12)]
    for s in own:
        s |= set(rng.integers(0, 20_000, 3000).tolist()) | set(rng.integers(2**40, 2**60, 2000).tolist())
    block = lambda ids: pa.table({"tree_id": pa.array(ids, pa.int64()), "keys": pa.array([sorted(own[i]) for i in ids], pa.list_(pa.int64()))})
    one, two = block(range(0, 12, 2)), block(range(1, 12, 2))
    tracemalloc.start()
    got = compare._pairs(one, two).to_pylist() + compare._pairs(two, one).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert {(r["tree_1"], r["tree_2"]): r["distance"] for r in got} == {(i, j): len(own[i] ^ own[j]) for i in range(12) for j in range(i + 1, 12) if (i + j) % 2}
    assert peak < 8e6
    none = pa.table({"tree_id": pa.array([50], pa.int64()), "keys": pa.array([[]], pa.list_(pa.int64()))})
    assert [r["distance"] for r in compare._pairs(one, none).to_pylist()] == [len(own[i]) for i in range(0, 12, 2)]


def test_bands(spark, collection, monkeypatch):
    """Clusters that do not nest are solved apart: bands of doubling sizes, several groups in each."""
    _, c = collection
    other = random_tree(random.Random(9), LABELS[20:28])
    two = Collection(lines(spark, [*(random_tree(random.Random(k), LABELS[:8]) for k in range(4)), *[other] * 3]))
    options = dp.candidates(two.weights, two.words).withColumn("su", bits.size("u", two.words))
    sizes = [tuple(r) for r in options.groupBy("su").count().orderBy("su").collect()]
    placed, bands = dp._plan(options, sizes, two.words, sum(k for _, k in sizes) - 1)
    assert len(bands) < len(sizes) and placed.where("su = 2").select("comp").distinct().count() > 1
    want = {r.u.w0: r.score for r in dp.solve(two.weights, two.root, two.words).collect()}
    assert {r.u.w0: r.score for r in dp.solve(two.weights, two.root, two.words, sum(k for _, k in sizes) - 1).collect()} == want


def test_temporary_removes_all(spark):
    work = work_dir(spark).removeprefix("file://")
    before = set(os.listdir(work))
    with temporary(spark):
        found = infer_species_tree(lines(spark, [random_tree(random.Random(4), LABELS[:7]) for _ in range(3)]), Options(support="both")).first()
        assert set(os.listdir(work)) - before
    assert found.newick and set(os.listdir(work)) == before


def test_components(spark):
    rng = random.Random(6)
    links = [(i, i + 1) for i in range(100, 140)] + [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    root = {x: x for e in links for x in e}
    for _ in range(200):
        for u, v in links:
            root[u] = root[v] = min(root[u], root[v])
    assert got == {x: root[x] for x in got} and set(got) >= {x for u, v in links if u != v for x in (u, v)}


def test_range_index(spark, collection):
    """Common leaves of any two ranges of two orders, against sets; with questions dealt to several tasks."""
    import numpy as np

    rng = np.random.default_rng(2)
    for n, m in ((1, 1), (5, 9), (64, 64), (100, 37)):
        one, two = rng.permutation(120)[:n], rng.permutation(120)[:m]
        index = orders.RangeIndex(one, two)
        cuts = np.sort(rng.integers(0, n + 1, (200, 2)), 1), np.sort(rng.integers(0, m + 1, (200, 2)), 1)
        got = index.common(cuts[0][:, 0], cuts[0][:, 1], cuts[1][:, 0], cuts[1][:, 1])
        assert got.tolist() == [len(set(one[a:b].tolist()) & set(two[x:y].tolist())) for (a, b), (x, y) in zip(*cuts, strict=True)]
    trees, c = collection
    by_tree = {}
    for r in c.order.collect():
        by_tree.setdefault(r.tree_id, {})[r.pos] = r.taxon
    asked = [(i, t, a, b, u, x, y) for i, (t, u, a, b, x, y) in enumerate((t, u, a, b, x, y) for t in (0, 5) for u in (5, 11) for a in (0, 2) for b in (3, 6) for x in (0, 1) for y in (4, 6))]
    df = spark.createDataFrame(asked, "id long, tree_1 long, start_1 long, end_1 long, tree_2 long, start_2 long, end_2 long")
    got = {r.id: r.common for r in weights.range_overlaps(df, c.arrays, 3).collect()}
    assert got == {i: len({by_tree[t][k] for k in range(a, b)} & {by_tree[u][k] for k in range(x, y)}) for i, t, a, b, u, x, y in asked}


def test_hash_groups(spark, collection):
    """Sets that share a hash are compared exactly: forced collisions are reported and told apart."""
    _, c = collection
    occurrences = c.nodes.select("tree_id", "start", "mid", "end", bits.union("left", "right", 1).alias("u")).withColumn("key", F.xxhash64("u"))
    assert splits.check_groups(occurrences.drop("u"), c.arrays).where("part > 0").isEmpty()
    forced = occurrences.withColumn("key", F.pmod(F.xxhash64("u"), F.lit(5)))
    found = splits.check_groups(forced.drop("u"), c.arrays)
    both = found.join(forced.drop("key"), ["tree_id", "start", "mid", "end"])
    assert found.count() == c.nodes.count() and found.where("part > 0").count() > 0
    each = both.groupBy("key", "part").agg(F.count_distinct("u").alias("sets"))
    assert each.where("sets > 1").isEmpty()
    assert both.groupBy("key", "u").agg(F.count_distinct("part").alias("parts")).where("parts > 1").isEmpty()

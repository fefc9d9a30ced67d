"""Queries over the driver tables, by name, with the SQL that must give the same rows.

Gene trees are derived from orders and customers, written as Newick text, and parsed again; everything else follows
from the parsed trees. Sets of nations fit in one word, so set columns are shown as integers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeworks.functions import bits, support
from cladeworks.jobs import reports
from cladeworks.jobs.trees import Collection, Options, derived_trees, infer_species_tree
from cladeworks.operators import ancestry, compare, dp, quartets, splits, weights
from cladeworks.session import settle
from cladeworks.sources import derived, stats

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = "WITH " + sql.strip()
        return f

    return add


def _word(c: str, name: str | None = None):
    return F.col(f"{c}.w0").alias(name or c)


def _first_tree(trees: Collection) -> DataFrame:
    """u, a, b of the tree with the smallest number, which stands in for a species tree."""
    first = trees.nodes.agg(F.min("tree_id").alias("tree_id"))
    own = trees.nodes.join(F.broadcast(first), "tree_id")
    return own.select(bits.union("left", "right", 1).alias("u"), F.least("left", "right").alias("a"), F.greatest("left", "right").alias("b"))


#: The derived trees in SQL: leaves in order, members of splits, splits, distinct splits.
LEAVES = """
cell AS (SELECT CAST(year(o_orderdate) * 10 + CAST(substr(o_orderpriority, 1, 1) AS INT) AS INT) AS tree_id, c_nationkey AS taxon, max(o_totalprice) AS m
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
gene_leaf AS (SELECT tree_id, taxon, row_number() OVER (PARTITION BY tree_id ORDER BY m DESC, taxon) - 1 AS pos FROM cell)"""
MONTHLY = LEAVES.replace("year(o_orderdate) * 10", "(year(o_orderdate) * 100 + month(o_orderdate)) * 10")
REGIONS = """
cell AS (SELECT CAST(year(o_orderdate) * 10 + CAST(substr(o_orderpriority, 1, 1) AS INT) AS INT) AS tree_id, n_regionkey AS taxon, max(o_totalprice) AS m
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2),
gene_leaf AS (SELECT tree_id, taxon, row_number() OVER (PARTITION BY tree_id ORDER BY m DESC, taxon) - 1 AS pos FROM cell)"""
SPLITS = """,
member AS (SELECT tree_id, lvl, pos >> (lvl + 1) AS blk, (pos >> lvl) & 1 AS side, taxon FROM gene_leaf, (SELECT unnest([0, 1, 2, 3, 4]) AS lvl)),
split AS (SELECT tree_id, lvl, blk, CAST(sum(CASE WHEN side = 0 THEN CAST(1 AS BIGINT) << taxon ELSE 0 END) AS BIGINT) AS l, CAST(sum(CASE WHEN side = 1 THEN CAST(1 AS BIGINT) << taxon ELSE 0 END) AS BIGINT) AS r
  FROM member GROUP BY 1, 2, 3 HAVING count(DISTINCT side) = 2),
occurrence AS (SELECT tree_id, least(l, r) AS a, greatest(l, r) AS b FROM split),
dsplit AS (SELECT a, b, count(*) AS freq FROM occurrence GROUP BY 1, 2)"""
CATERPILLARS = """,
leafbit AS (SELECT tree_id, pos, CAST(1 AS BIGINT) << taxon AS m FROM gene_leaf),
split AS (SELECT x.tree_id, x.m AS l, CAST(sum(y.m) AS BIGINT) AS r FROM leafbit x JOIN leafbit y ON x.tree_id = y.tree_id AND y.pos > x.pos GROUP BY x.tree_id, x.pos, x.m),
occurrence AS (SELECT tree_id, least(l, r) AS a, greatest(l, r) AS b FROM split),
dsplit AS (SELECT a, b, count(*) AS freq FROM occurrence GROUP BY 1, 2)"""
OVERLAPS = """,
pair AS (SELECT c.a AS ca, c.b AS cb, s.freq, CAST(bit_count(c.a & s.a) AS BIGINT) AS aa, CAST(bit_count(c.b & s.b) AS BIGINT) AS bb,
  CAST(bit_count(c.a & s.b) AS BIGINT) AS ab, CAST(bit_count(c.b & s.a) AS BIGINT) AS ba FROM dsplit c, dsplit s),
weight AS (SELECT ca AS a, cb AS b, CAST(sum(freq * ((aa * bb * (aa + bb - 2)) // 2 + (ab * ba * (ab + ba - 2)) // 2)) AS BIGINT) AS weight FROM pair GROUP BY 1, 2)"""
TREES = """,
whole AS (SELECT tree_id, CAST(sum(CAST(1 AS BIGINT) << taxon) AS BIGINT) AS w, count(*) AS n FROM gene_leaf GROUP BY 1),
edge AS (SELECT DISTINCT o.tree_id, least(a | b, w & ~(a | b)) AS s FROM occurrence o JOIN whole USING (tree_id)
  WHERE bit_count(a | b) > 1 AND bit_count(w & ~(a | b)) > 1),
spaces AS (SELECT count(DISTINCT taxon) AS n FROM gene_leaf),
size AS (SELECT w.tree_id, count(e.s) AS k FROM whole w LEFT JOIN edge e USING (tree_id) GROUP BY 1)"""
PAIRS = """,
shared AS (SELECT x.tree_id AS t1, y.tree_id AS t2, count(*) AS c FROM edge x JOIN edge y ON x.s = y.s AND x.tree_id < y.tree_id GROUP BY 1, 2),
rf AS (SELECT CAST(x.tree_id AS BIGINT) AS tree_1, CAST(y.tree_id AS BIGINT) AS tree_2, CAST(x.k + y.k - 2 * coalesce(c, 0) AS BIGINT) AS distance,
  CASE WHEN n <= 3 THEN 0.0 ELSE least(1.0, (x.k + y.k - 2 * coalesce(c, 0)) / (2.0 * (n - 3))) END AS nrf
  FROM size x JOIN size y ON x.tree_id < y.tree_id LEFT JOIN shared ON t1 = x.tree_id AND t2 = y.tree_id CROSS JOIN spaces)"""
VERSUS = """,
first AS (SELECT min(tree_id) AS t FROM occurrence),
vs AS (SELECT z.tree_id, CAST(z.k + (SELECT k FROM size JOIN first ON tree_id = t) - 2 * count(f.s) AS BIGINT) AS distance FROM size z LEFT JOIN edge e ON e.tree_id = z.tree_id
  LEFT JOIN (SELECT s FROM edge JOIN first ON tree_id = t) f ON f.s = e.s GROUP BY z.tree_id, z.k),
vrf AS (SELECT tree_id, distance, CASE WHEN n <= 3 THEN 0.0 ELSE least(1.0, distance / (2.0 * (n - 3))) END AS nrf FROM vs CROSS JOIN spaces)"""
QUADS = """,
sp AS (SELECT a, b, a | b AS u FROM occurrence WHERE tree_id = (SELECT min(tree_id) FROM occurrence)),
every AS (SELECT CAST(sum(CAST(1 AS BIGINT) << taxon) AS BIGINT) AS w FROM (SELECT DISTINCT taxon FROM gene_leaf)),
up AS (SELECT a AS u, b AS sib FROM sp UNION ALL SELECT b, a FROM sp),
quad AS (SELECT sp.u AS branch, sp.a AS q1, sp.b AS q2, coalesce(t.a, sib) AS q3, coalesce(t.b, w & ~(sp.u | sib)) AS q4
  FROM sp JOIN up ON up.u = sp.u LEFT JOIN sp t ON t.u = sib CROSS JOIN every WHERE coalesce(t.b, w & ~(sp.u | sib)) <> 0)"""
COUNTS = """,
part AS (SELECT branch, freq, CAST(bit_count(q1 & a) AS BIGINT) AS al, CAST(bit_count(q1 & b) AS BIGINT) AS ar, CAST(bit_count(q2 & a) AS BIGINT) AS bl, CAST(bit_count(q2 & b) AS BIGINT) AS br,
  CAST(bit_count(q3 & a) AS BIGINT) AS cl, CAST(bit_count(q3 & b) AS BIGINT) AS cr, CAST(bit_count(q4 & a) AS BIGINT) AS dl, CAST(bit_count(q4 & b) AS BIGINT) AS dr FROM quad, dsplit),
tops AS (SELECT branch, CAST(sum(freq * (al * bl * cr * dr + ar * br * cl * dl)) AS BIGINT) AS f1, CAST(sum(freq * (al * cl * br * dr + ar * cr * bl * dl)) AS BIGINT) AS f2,
  CAST(sum(freq * (al * dl * br * cr + ar * dr * bl * cl)) AS BIGINT) AS f3 FROM part GROUP BY 1),
whole AS (SELECT tree_id, CAST(sum(CAST(1 AS BIGINT) << taxon) AS BIGINT) AS w FROM gene_leaf GROUP BY 1),
ns AS (SELECT branch, CAST(sum(CAST(bit_count(q1 & w) AS BIGINT) * bit_count(q2 & w) * bit_count(q3 & w) * bit_count(q4 & w)) AS BIGINT) AS n,
  CAST(max(CAST(bit_count(q1) AS BIGINT) * bit_count(q2) * bit_count(q3) * bit_count(q4)) AS BIGINT) AS possible FROM quad, whole GROUP BY 1),
freqs AS (SELECT branch, f1, f2, f3, n, possible FROM tops JOIN ns USING (branch))"""
SUPPORT = """,
term AS (SELECT branch, k, m, n, lgamma(n + 2.0) - lgamma(i + 1.0) - lgamma(n + 2.0 - i) + i * ln(1.0 / 3) + (n + 1 - i) * ln(2.0 / 3) AS lp
  FROM (SELECT branch, n, k, m, unnest(generate_series(CAST(0 AS BIGINT), m)) AS i FROM (SELECT branch, n, unnest([1, 2, 3]) AS k, unnest([f1, f2, f3]) AS m FROM freqs WHERE n >= 1))),
tail AS (SELECT branch, k, m, n, sum(exp(lp)) AS g FROM term GROUP BY 1, 2, 3, 4),
lik AS (SELECT t.branch, t.k, CASE WHEN t.g > 2.22e-16 THEN ln(t.g) + ln(2.0) * (t.m - f1) + lgamma(t.m + 1.0) + lgamma(t.n - t.m + 1.0) - lgamma(f1 + 1.0) - lgamma(t.n - f1 + 1.0) END AS lg
  FROM tail t JOIN freqs USING (branch)),
post AS (SELECT x.branch, CASE WHEN x.lg IS NULL THEN 0.0 ELSE 1 / sum(CASE WHEN y.lg IS NULL THEN 0.0 WHEN y.lg - x.lg > 700 THEN CAST('inf' AS DOUBLE) ELSE exp(y.lg - x.lg) END) END AS pp
  FROM lik x JOIN lik y ON x.branch = y.branch WHERE x.k = 1 GROUP BY x.branch, x.lg)"""
LENGTH = "CASE WHEN f1 / (n + 1.0) > 1.0 / 3 THEN -ln(1.5 * (1 - f1 / (n + 1.0))) ELSE 0.0 END"
P_VALUE = "CASE WHEN n > 15 THEN exp(-((f1 - n / 3.0) * (f1 - n / 3.0) + (f2 - n / 3.0) * (f2 - n / 3.0) + (f3 - n / 3.0) * (f3 - n / 3.0)) / (n / 3.0) / 2) END"


@query(LEAVES + " SELECT DISTINCT taxon, 'T' || lpad(CAST(taxon AS VARCHAR), 2, '0') AS label FROM gene_leaf")
def taxon_dictionary(spark, sf_dir):
    """Labels that the parsed trees hold, with numbers."""
    trees = derived_trees(spark, sf_dir)
    return trees.leaves.select("label").distinct().join(trees.taxa, "label").select("taxon", "label")


@query(LEAVES + " SELECT row_number() OVER (ORDER BY label) - 1 AS taxon, label FROM (SELECT DISTINCT 'T' || lpad(CAST(taxon AS VARCHAR), 2, '0') AS label FROM gene_leaf)")
def taxon_numbers(spark, sf_dir):
    """Taxa numbered anew in the order of their labels."""
    return splits.dictionary(derived_trees(spark, sf_dir).leaves)


@query(LEAVES + " SELECT tree_id, taxon, pos FROM gene_leaf")
def gene_leaf_order(spark, sf_dir):
    return derived_trees(spark, sf_dir).order


@query(LEAVES + " SELECT t.tree_id, x.taxon, pos FROM (SELECT DISTINCT tree_id FROM gene_leaf) t CROSS JOIN (SELECT DISTINCT taxon FROM gene_leaf) x LEFT JOIN gene_leaf g ON g.tree_id = t.tree_id AND g.taxon = x.taxon")
def inverse_index(spark, sf_dir):
    """The place of each taxon in each tree, null where it is absent."""
    trees = derived_trees(spark, sf_dir)
    grid = trees.order.select("tree_id").distinct().crossJoin(F.broadcast(trees.taxa.select("taxon")))
    return grid.join(trees.order, ["tree_id", "taxon"], "left")


@query(LEAVES + """, z AS (SELECT tree_id, count(*) AS n FROM gene_leaf GROUP BY 1), x AS (SELECT count(DISTINCT taxon) AS n_taxa FROM gene_leaf)
SELECT count(*) AS n_trees, any_value(n_taxa) AS n_taxa, CAST(sum(n) AS BIGINT) AS n_leaves, min(n) AS smallest, max(n) AS largest, CAST(count(*) * any_value(n_taxa) - sum(n) AS BIGINT) AS n_missing,
round(sum(n) * 100.0 / (count(*) * any_value(n_taxa)), 6) AS coverage_pct FROM z, x""")
def taxa_coverage(spark, sf_dir):
    return splits.coverage(derived_trees(spark, sf_dir).order).withColumn("coverage_pct", F.round("coverage_pct", 6))


@query(LEAVES + " SELECT count(*) - count(DISTINCT (tree_id, taxon)) AS repeated, count(*) FILTER (WHERE pos < 0) AS negative, CAST(sum(pos) - sum(r) AS BIGINT) AS not_dense FROM (SELECT *, row_number() OVER (PARTITION BY tree_id ORDER BY pos) - 1 AS r FROM gene_leaf)")
def index_checks(spark, sf_dir):
    """Whether each taxon stands once in a tree and places are 0, 1, 2, and so on: all three must be 0."""
    order = derived_trees(spark, sf_dir).order
    trees = order.groupBy("tree_id").agg(F.count("*").alias("k"), F.count_distinct("taxon").alias("d"), F.sum("pos").alias("s"), F.count_if(F.col("pos") < 0).alias("neg"))
    return trees.agg(F.sum(F.col("k") - F.col("d")).alias("repeated"), F.sum("neg").alias("negative"), F.sum(F.col("s") - F.shiftright(F.col("k") * (F.col("k") - 1), 1)).alias("not_dense"))


@query(LEAVES + SPLITS + " SELECT tree_id, a, b FROM occurrence")
def split_occurrences(spark, sf_dir):
    nodes = derived_trees(spark, sf_dir).nodes
    return nodes.select("tree_id", F.least("left.w0", "right.w0").alias("a"), F.greatest("left.w0", "right.w0").alias("b"))


@query(LEAVES + CATERPILLARS + " SELECT tree_id, a, b FROM occurrence")
def caterpillar_occurrences(spark, sf_dir):
    nodes = derived_trees(spark, sf_dir, shape="caterpillar").nodes
    return nodes.select("tree_id", F.least("left.w0", "right.w0").alias("a"), F.greatest("left.w0", "right.w0").alias("b"))


@query(LEAVES + SPLITS + " SELECT a, b, freq FROM dsplit")
def split_frequency(spark, sf_dir):
    return derived_trees(spark, sf_dir).splits.select(_word("a"), _word("b"), "freq")


@query(MONTHLY + SPLITS + " SELECT a, b, freq FROM dsplit")
def split_frequency_monthly(spark, sf_dir):
    """As split_frequency, with a tree for each month and priority."""
    return derived_trees(spark, sf_dir, monthly=True).splits.select(_word("a"), _word("b"), "freq")


@query(LEAVES + SPLITS + " SELECT count(DISTINCT tree_id) AS n_trees, count(*) AS n_occurrences, (SELECT count(*) FROM dsplit) AS n_distinct, round(count(*) / CAST(greatest(1, (SELECT count(*) FROM dsplit)) AS DOUBLE), 6) AS factor FROM occurrence")
def reduction_factor(spark, sf_dir):
    trees = derived_trees(spark, sf_dir)
    k = trees.splits.agg(F.count("*").alias("n_distinct"))
    row = trees.nodes.agg(F.count_distinct("tree_id").alias("n_trees"), F.count("*").alias("n_occurrences")).crossJoin(k)
    return row.withColumn("factor", F.round(F.col("n_occurrences") / F.greatest(F.lit(1), "n_distinct"), 6))


@query(LEAVES + SPLITS + ", m AS (SELECT a AS mask FROM dsplit UNION SELECT b FROM dsplit UNION SELECT a | b FROM dsplit) SELECT mask, CAST(bit_count(mask) AS BIGINT) AS size FROM m")
def cluster_universe(spark, sf_dir):
    return splits.clusters(derived_trees(spark, sf_dir).splits, 1).select(_word("mask"), "size")


@query(LEAVES + SPLITS + """, f AS (SELECT DISTINCT tree_id, a, b FROM occurrence WHERE tree_id = (SELECT min(tree_id) FROM occurrence)),
o AS (SELECT f.a AS ca, f.b AS cb, s.a AS sa, s.b AS sb, CAST(bit_count(f.a & s.a) AS BIGINT) AS aa, CAST(bit_count(f.b & s.b) AS BIGINT) AS bb, CAST(bit_count(f.a & s.b) AS BIGINT) AS ab, CAST(bit_count(f.b & s.a) AS BIGINT) AS ba FROM f, dsplit s)
SELECT * FROM o WHERE aa + bb + ab + ba > 0""")
def range_intersections(spark, sf_dir):
    """Overlaps of the first tree's splits with all distinct ones: common leaves of ranges, by an index of each two trees."""
    trees = derived_trees(spark, sf_dir)
    first = trees.nodes.join(F.broadcast(trees.nodes.agg(F.min("tree_id").alias("tree_id"))), "tree_id")
    sides = lambda s, m, e, left, right: F.when(left < right, F.array(F.struct(s, m), F.struct(m, e))).otherwise(F.array(F.struct(m, e), F.struct(s, m)))
    c = [F.col(x).cast("long") for x in ("start", "mid", "end")]
    one = first.select(F.least("left.w0", "right.w0").alias("ca"), F.greatest("left.w0", "right.w0").alias("cb"), F.col("tree_id").alias("tree_1"), sides(*c, F.col("left.w0"), F.col("right.w0")).alias("x"))
    f = trees.splits.join(trees.nodes.select("tree_id", "start", "mid", "end", "left", "right"), (F.col("first.tree_id") == F.col("tree_id")) & (F.col("first.mid") == F.col("mid")))
    two = f.select(F.col("a.w0").alias("sa"), F.col("b.w0").alias("sb"), F.col("tree_id").alias("tree_2"), sides(*c, F.col("left.w0"), F.col("right.w0")).alias("y"))
    pairs = settle(two.crossJoin(F.broadcast(one)), "pairs")  # the splits of one tree with all
    kinds = {"aa": (0, 0), "bb": (1, 1), "ab": (0, 1), "ba": (1, 0)}
    asked = pairs.select("ca", "cb", "sa", "sb", "tree_1", "tree_2", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col("x")[i].alias("p"), F.col("y")[j].alias("q")) for k, (i, j) in kinds.items()))).alias("z"))
    asked = settle(asked.withColumn("id", F.monotonically_increasing_id()), "questions")
    ends = [F.col(f"z.{k}.col{i}").alias(f"{name}_{n}") for n, k in ((1, "p"), (2, "q")) for i, name in ((1, "start"), (2, "end"))]
    found = weights.range_overlaps(asked.select("id", "tree_1", "tree_2", *ends), trees.arrays)
    total = [F.sum(F.when(F.col("z.kind") == k, F.col("common"))).alias(k) for k in kinds]
    return asked.join(found, "id").groupBy("ca", "cb", "sa", "sb").agg(*total).where("aa + bb + ab + ba > 0")


@query(LEAVES + SPLITS + " SELECT count(*) AS n_occurrences, (SELECT count(*) FROM dsplit) AS n_distinct, CAST(0 AS BIGINT) AS n_collisions FROM occurrence")
def hash_collisions(spark, sf_dir):
    """Occurrences of splits whose hashes are equal though their leaves are not: each is compared with the first one of its hash."""
    trees = derived_trees(spark, sf_dir)
    rows = trees.nodes.select("tree_id", "start", "mid", "end", F.xxhash64(F.least("left", "right"), F.greatest("left", "right")).alias("key"))
    found = splits.check_groups(rows, trees.arrays, halves=True)
    return found.agg(F.count("*").alias("n_occurrences"), F.count_distinct("key", "part").alias("n_distinct"), F.count_if(F.col("part") > 0).alias("n_collisions"))


@query(LEAVES + SPLITS + OVERLAPS + " SELECT a, b, weight FROM weight")
def split_weights(spark, sf_dir):
    return derived_trees(spark, sf_dir).weights.select(_word("a"), _word("b"), "weight")


@query(LEAVES + CATERPILLARS + OVERLAPS + " SELECT a, b, weight FROM weight")
def caterpillar_weights(spark, sf_dir):
    return derived_trees(spark, sf_dir, shape="caterpillar").weights.select(_word("a"), _word("b"), "weight")


@query(MONTHLY + SPLITS + OVERLAPS + " SELECT a, b, weight FROM weight")
def split_weights_monthly(spark, sf_dir):
    return derived_trees(spark, sf_dir, monthly=True).weights.select(_word("a"), _word("b"), "weight")


@query(LEAVES + SPLITS + OVERLAPS + " SELECT a, b, weight FROM weight")
def split_weights_by_order(spark, sf_dir):
    """The weights again, from leaf orders instead of sets: the way for trees with many taxa."""
    trees = derived_trees(spark, sf_dir)
    members = lambda c: F.filter(F.sequence(F.lit(0), F.lit(61)), lambda i: F.call_function("bit_get", F.col(c), i) == 1)
    rows = trees.splits.select(_word("a"), _word("b")).withColumn("id", F.xxhash64("a", "b"))
    rows = rows.withColumn("left", members("a")).withColumn("right", members("b"))
    found = weights.weights_by_order(rows, weights.tree_arrays(trees.order, trees.nodes))
    return rows.select("id", "a", "b").join(found, "id").select("a", "b", "weight")


@query(LEAVES + SPLITS + OVERLAPS + " SELECT count(*) AS n, min(weight) AS least, max(weight) AS most, round(avg(weight), 6) AS mean FROM weight")
def weight_stats(spark, sf_dir):
    w = F.col("weight")
    return derived_trees(spark, sf_dir).weights.agg(F.count("*").alias("n"), F.min(w).alias("least"), F.max(w).alias("most"), F.round(F.avg(w), 6).alias("mean"))


@query(LEAVES + SPLITS + " SELECT a | b AS u, count(*) AS n_candidates FROM dsplit GROUP BY 1")
def candidates_per_cluster(spark, sf_dir):
    found = derived_trees(spark, sf_dir).splits.select(bits.union("a", "b", 1).alias("u"))
    return found.groupBy(_word("u")).agg(F.count("*").alias("n_candidates"))


@query(LEAVES + SPLITS + OVERLAPS + ", r AS (SELECT a | b AS u, a, b, weight, row_number() OVER (PARTITION BY a | b ORDER BY weight DESC, a, b) AS k FROM weight) SELECT u, a, b, weight FROM r WHERE k = 1")
def best_local_split(spark, sf_dir):
    return dp.best_local(derived_trees(spark, sf_dir).weights, 1).select(_word("u"), _word("a"), _word("b"), "weight")


@query(LEAVES + ", z AS (SELECT tree_id, count(*) AS n, CAST(sum(CAST(1 AS BIGINT) << taxon) AS BIGINT) AS mask FROM gene_leaf GROUP BY 1) SELECT tree_id AS root_tree, mask, n AS n_leaves, n = (SELECT count(DISTINCT taxon) FROM gene_leaf) AS is_complete FROM z ORDER BY n DESC, tree_id LIMIT 1")
def root_tree_choice(spark, sf_dir):
    return derived_trees(spark, sf_dir).root.select("root_tree", _word("mask"), "n_leaves", "is_complete")


_REGION_DP = REGIONS + SPLITS + OVERLAPS + """, c AS (SELECT a | b AS u, a, b, weight FROM weight),
d3 AS (SELECT u, max(weight) AS s FROM c WHERE bit_count(u) = 3 GROUP BY 1),
k4 AS (SELECT c.u, max(weight + coalesce(x.s, 0) + coalesce(y.s, 0)) AS s FROM c LEFT JOIN d3 x ON x.u = c.a LEFT JOIN d3 y ON y.u = c.b WHERE bit_count(c.u) = 4 GROUP BY 1),
d34 AS (SELECT * FROM d3 UNION ALL SELECT * FROM k4),
k5 AS (SELECT c.u, max(weight + coalesce(x.s, 0) + coalesce(y.s, 0)) AS s FROM c LEFT JOIN d34 x ON x.u = c.a LEFT JOIN d34 y ON y.u = c.b WHERE bit_count(c.u) = 5 GROUP BY 1),
d2 AS (SELECT DISTINCT u, CAST(0 AS BIGINT) AS s FROM c WHERE bit_count(u) = 2)
SELECT u, CAST(s AS BIGINT) AS score FROM (SELECT * FROM d2 UNION ALL SELECT * FROM d34 UNION ALL SELECT * FROM k5)"""


@query(_REGION_DP)
def dp_score_regions(spark, sf_dir):
    """The best total of each cluster of regions."""
    return derived_trees(spark, sf_dir, "region").solved.select(_word("u"), "score")


@query(_REGION_DP)
def dp_rounds_regions(spark, sf_dir):
    """The same totals by rounds of joins, the way for many candidates."""
    trees = derived_trees(spark, sf_dir, "region")
    return dp.solve(trees.weights, trees.root, 1, one_task=0).select(_word("u"), "score")


def _nation_dp(n: int) -> str:
    """The totals of all clusters of up to n taxa, size by size, each from those of smaller ones; then the tree from its root down."""
    parts = ["c AS MATERIALIZED (SELECT a | b AS u, a, b, weight, bit_count(a | b) AS size FROM weight)", "d1 AS (SELECT CAST(NULL AS BIGINT) AS u, CAST(NULL AS BIGINT) AS a, CAST(NULL AS BIGINT) AS b, CAST(0 AS BIGINT) AS score WHERE false)"]
    for k in range(2, n + 1):
        total = "0" if k == 2 else "c.weight + coalesce(x.score, 0) + coalesce(y.score, 0)"
        one = f"SELECT c.u, c.a, c.b, CAST({total} AS BIGINT) AS score FROM c LEFT JOIN d{k - 1} x ON x.u = c.a LEFT JOIN d{k - 1} y ON y.u = c.b WHERE size = {k}"
        best = f"SELECT u, a, b, score FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY score DESC, a, b) AS r FROM ({one})) WHERE r = 1"
        parts.append(f"d{k} AS MATERIALIZED (SELECT * FROM d{k - 1} UNION ALL {best})")
    parts.append("root AS (SELECT CAST(sum(CAST(1 AS BIGINT) << taxon) AS BIGINT) AS mask FROM gene_leaf WHERE tree_id = (SELECT tree_id FROM gene_leaf GROUP BY 1 ORDER BY count(*) DESC, tree_id LIMIT 1))")
    tree = f"tree AS (SELECT d.u, d.a, d.b FROM d{n} d JOIN root ON u = mask UNION SELECT d.u, d.a, d.b FROM tree t JOIN d{n} d ON d.u = t.a OR d.u = t.b)"
    return "RECURSIVE " + LEAVES + SPLITS + OVERLAPS + ", " + ", ".join([*parts, tree]) + f" SELECT d.u, d.a, d.b, d.score, t.u IS NOT NULL AS in_tree FROM d{n} d LEFT JOIN tree t ON t.u = d.u"


@query(_nation_dp(25))
def dp_score_nations(spark, sf_dir):
    return derived_trees(spark, sf_dir).solved.select(_word("u"), _word("a"), _word("b"), "score", "in_tree")


@query()
def species_tree_newick(spark, sf_dir):
    """The species tree of all derived gene trees, its branches annotated with all support values."""
    leaves = derived.gene_leaves(spark, sf_dir)
    return infer_species_tree(derived.newick(leaves), Options(support="all"))


@query(LEAVES + SPLITS + QUADS + " SELECT branch, q1, q2, q3, q4 FROM quad")
def quadripartitions(spark, sf_dir):
    trees = derived_trees(spark, sf_dir)
    every = trees.taxa.agg(F.struct(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("taxon").cast("int"))).alias("w0")).alias("mask"))
    found = quartets.quadripartitions(_first_tree(trees), every, 1)
    return found.select(*map(_word, ("branch", "q1", "q2", "q3", "q4")))


def _branches(spark, sf_dir) -> DataFrame:
    trees = derived_trees(spark, sf_dir)
    return trees.branches(_first_tree(trees)).withColumn("branch", F.col("branch.w0"))


@query(LEAVES + SPLITS + QUADS + COUNTS + " SELECT * FROM freqs")
def quartet_frequencies(spark, sf_dir):
    return _branches(spark, sf_dir).select("branch", "f1", "f2", "f3", "n", "possible")


@query(LEAVES + SPLITS + QUADS + COUNTS + " SELECT count(*) FILTER (WHERE least(f1, f2, f3) < 0) AS negative, count(*) FILTER (WHERE greatest(f1, f2, f3) > n) AS above_n, count(*) FILTER (WHERE f1 + f2 + f3 <> n) AS not_all_resolved, count(*) FILTER (WHERE n > possible) AS above_possible FROM freqs")
def quartet_checks(spark, sf_dir):
    return quartets.checks(_branches(spark, sf_dir))


@query(LEAVES + SPLITS + QUADS + COUNTS + f" SELECT branch, round({LENGTH}, 6) AS length FROM freqs")
def branch_length(spark, sf_dir):
    return _branches(spark, sf_dir).select("branch", F.round("length", 6).alias("length"))


@query(LEAVES + SPLITS + QUADS + COUNTS + f" SELECT branch, round({P_VALUE}, 6) AS p_value FROM freqs")
def p_value(spark, sf_dir):
    return _branches(spark, sf_dir).select("branch", F.round("p_value", 6).alias("p_value"))


@query(LEAVES + SPLITS + QUADS + COUNTS + SUPPORT + " SELECT branch, round(pp, 6) AS posterior FROM freqs LEFT JOIN post USING (branch)")
def posterior_lambda_half(spark, sf_dir):
    return _branches(spark, sf_dir).select("branch", F.round("posterior", 6).alias("posterior"))


@query(LEAVES + SPLITS + QUADS + COUNTS + SUPPORT + """ SELECT count(*) AS n_branches, count(pp) AS n_valid, count(*) FILTER (WHERE pp >= 0.95) AS high, count(*) FILTER (WHERE pp >= 0.75 AND pp < 0.95) AS medium,
count(*) FILTER (WHERE pp < 0.75) AS low, round(avg(pp), 6) AS mean_posterior, round(avg(n) FILTER (WHERE n >= 1), 6) AS mean_n, round(sum(CASE WHEN pp > 0 THEN ln(pp) END), 4) AS log_posterior, count(*) FILTER (WHERE n >= 1 AND n < 20) AS few FROM freqs LEFT JOIN post USING (branch)""")
def support_bins(spark, sf_dir):
    p, n = F.col("posterior"), F.col("n")
    return _branches(spark, sf_dir).agg(
        F.count("*").alias("n_branches"), F.count(p).alias("n_valid"), F.count_if(p >= 0.95).alias("high"), F.count_if((p >= 0.75) & (p < 0.95)).alias("medium"), F.count_if(p < 0.75).alias("low"),
        F.round(F.avg(p), 6).alias("mean_posterior"), F.round(F.avg(F.when(n >= 1, n)), 6).alias("mean_n"), F.round(F.sum(F.when(p > 0, F.log(p))), 4).alias("log_posterior"), F.count_if((n >= 1) & (n < 20)).alias("few"),
    )


@query(LEAVES + SPLITS + QUADS + COUNTS + f""", x AS (SELECT *, {LENGTH} AS bl, {P_VALUE} AS pv FROM freqs)
SELECT branch, printf('%.4f', bl) AS length, printf('%.1f', CAST(f1 AS DOUBLE)) || ';' || printf('%.1f', CAST(n AS DOUBLE)) AS counts, CASE WHEN pv IS NULL THEN 'NA' ELSE regexp_replace(regexp_replace(printf('%.4f', pv), '0+$', ''), '[.]$', '') END AS p_value FROM x""")
def branch_annotations(spark, sf_dir):
    b = _branches(spark, sf_dir)
    counts = F.concat(F.format_string("%.1f", F.col("f1").cast("double")), F.lit(";"), F.format_string("%.1f", F.col("n").cast("double")))
    return b.select("branch", F.format_string("%.4f", "length").alias("length"), counts.alias("counts"), support.annotation("pvalue", F.col("posterior"), F.col("length"), F.col("p_value"), [], F.col("n")).alias("p_value"))


def _edges(trees: Collection) -> DataFrame:
    return compare.unrooted(trees.nodes, 1)


def _first_edges(trees: Collection, edges: DataFrame) -> DataFrame:
    return edges.join(F.broadcast(trees.nodes.agg(F.min("tree_id").alias("tree_id"))), "tree_id")


@query(LEAVES + SPLITS + TREES + PAIRS + " SELECT tree_1, tree_2, distance, round(nrf, 6) AS nrf FROM rf")
def rf_pairs(spark, sf_dir):
    trees = derived_trees(spark, sf_dir)
    found = compare.all_pairs(_edges(trees), trees.nodes)
    return found.withColumn("nrf", F.round(compare.normed(F.col("distance"), trees.taxa.count()), 6)).orderBy("nrf", "tree_1", "tree_2")


@query(LEAVES + SPLITS + TREES + VERSUS + " SELECT tree_id, distance, round(nrf, 6) AS nrf FROM vrf")
def rf_vs_species(spark, sf_dir):
    trees = derived_trees(spark, sf_dir)
    edges = _edges(trees)
    found = compare.to_one(edges, trees.nodes, _first_edges(trees, edges))
    return found.select("tree_id", "distance", F.round(compare.normed(F.col("distance"), trees.taxa.count()), 6).alias("nrf"))


@query(LEAVES + SPLITS + TREES + PAIRS + VERSUS + """, g AS (SELECT coalesce(avg(nrf), 0) AS x, count(*) AS n FROM rf), s AS (SELECT coalesce(avg(nrf), 0) AS x, count(*) AS n FROM vrf)
SELECT round(g.x, 6) AS gene_gene, g.n AS n_pairs, round((1 - g.x) * 100, 4) AS similarity_pct, CASE WHEN g.x < 0.3 THEN 'very similar' WHEN g.x < 0.6 THEN 'moderately similar' ELSE 'quite different' END AS pairs_are,
round(s.x, 6) AS gene_species, s.n AS n_trees, CASE WHEN s.x < 0.3 THEN 'very similar' WHEN s.x < 0.6 THEN 'moderately similar' ELSE 'quite different' END AS trees_are FROM g, s""")
def discordance_summary(spark, sf_dir):
    trees = derived_trees(spark, sf_dir)
    edges = _edges(trees)
    return reports.discordance(edges, trees.nodes, _first_edges(trees, edges), trees.taxa.count())


FIRST5 = """,
five AS (SELECT tree_id FROM size ORDER BY tree_id LIMIT 5), n5 AS (SELECT count(DISTINCT taxon) AS n FROM gene_leaf WHERE tree_id IN (SELECT tree_id FROM five)),
norm AS (SELECT CASE WHEN n <= 3 THEN NULL ELSE 2.0 * (n - 3) END AS w FROM n5),
g AS (SELECT coalesce(avg(coalesce(least(1.0, distance / w), 0)), 0) AS x, count(*) AS n FROM rf, norm WHERE tree_1 IN (SELECT tree_id FROM five) AND tree_2 IN (SELECT tree_id FROM five)),
s AS (SELECT coalesce(avg(coalesce(least(1.0, distance / w), 0)), 0) AS x, count(*) AS n FROM vs, norm WHERE tree_id IN (SELECT tree_id FROM five))"""


@query(LEAVES + SPLITS + TREES + PAIRS + VERSUS + FIRST5 + """ SELECT round(g.x, 6) AS gene_gene, g.n AS n_pairs, round((1 - g.x) * 100, 4) AS similarity_pct, CASE WHEN g.x < 0.3 THEN 'very similar' WHEN g.x < 0.6 THEN 'moderately similar' ELSE 'quite different' END AS pairs_are,
round(s.x, 6) AS gene_species, s.n AS n_trees, CASE WHEN s.x < 0.3 THEN 'very similar' WHEN s.x < 0.6 THEN 'moderately similar' ELSE 'quite different' END AS trees_are FROM g, s""")
def discordance_of_first_five(spark, sf_dir):
    """The report on the first five lines of a file, the first of which stands in for the species tree."""
    lines = derived.newick(derived.gene_leaves(spark, sf_dir))
    return reports.dataset_discordance(lines, lines, 5)


@query(LEAVES + SPLITS + TREES + VERSUS + " SELECT tree_id, CAST(tree_id AS VARCHAR) AS first_number, CAST(distance AS VARCHAR) AS last_field FROM vs")
def report_fields(spark, sf_dir):
    """Numbers taken back from the text of a report about each tree."""
    trees = derived_trees(spark, sf_dir)
    edges = _edges(trees)
    found = compare.to_one(edges, trees.nodes, _first_edges(trees, edges))
    text = F.concat(F.lit("Tree "), F.col("tree_id").cast("string"), F.lit("\nTaxa (shared): some\nAverage distance (to the first): about "), F.col("distance").cast("string"), F.lit(" \nEnd"))
    return found.select("tree_id", stats.first_number(text).alias("first_number"), stats.last_field(text, "Average distance").alias("last_field"))


@query(LEAVES + SPLITS + """, f AS (SELECT a | b AS u FROM occurrence WHERE tree_id = (SELECT min(tree_id) FROM occurrence)), o AS (SELECT tree_id, a | b AS u FROM occurrence)
SELECT o.tree_id, count(f.u) = count(*) AND count(*) = (SELECT count(*) FROM f) AS same FROM o LEFT JOIN f ON f.u = o.u GROUP BY 1""")
def same_topology(spark, sf_dir):
    """Which trees have the same rooted topology as the first one."""
    trees = derived_trees(spark, sf_dir)
    own = trees.nodes.select("tree_id", bits.union("left", "right", 1).alias("u"))
    return compare.same_topology(own, trees.nodes, _first_tree(trees))


@query(LEAVES + SPLITS + " SELECT tree_id, count(*) + 1 AS n_leaves, count(*) AS n_internal FROM occurrence GROUP BY 1")
def tree_info(spark, sf_dir):
    trees = derived_trees(spark, sf_dir)
    return trees.nodes.groupBy("tree_id").agg((F.count("*") + 1).alias("n_leaves"), F.count("*").alias("n_internal"))


@query(LEAVES + SPLITS + " SELECT tree_id, a, b FROM occurrence")
def newick_roundtrip(spark, sf_dir):
    """Splits after the parsed trees were written as canonical Newick text and parsed again."""
    trees = derived_trees(spark, sf_dir)
    rows = trees.nodes.select("tree_id", bits.union("left", "right", 1).alias("u"), F.col("left").alias("a"), F.col("right").alias("b"), F.lit(None).cast("string").alias("note"))
    again = Collection(dp.newick(rows, trees.taxa, 1), taxa=trees.taxa).nodes
    return again.select("tree_id", F.least("left.w0", "right.w0").alias("a"), F.greatest("left.w0", "right.w0").alias("b"))


@query(LEAVES + """, t AS (SELECT DISTINCT tree_id, count(*) OVER (PARTITION BY tree_id) AS n FROM gene_leaf)
SELECT CASE tree_id % 9 WHEN 1 THEN 'unbalanced' WHEN 2 THEN 'unbalanced' WHEN 3 THEN 'unbalanced' WHEN 6 THEN 'duplicate' WHEN 7 THEN 'not_binary' ELSE 'ok' END AS status, count(*) AS n_trees FROM t WHERE tree_id % 9 <> 8 GROUP BY 1""")
def bad_record_counts(spark, sf_dir):
    """Lines by what is wrong with them, where faults were put into two thirds of the derived trees."""
    leaves = derived.gene_leaves(spark, sf_dir)
    status = Collection(derived.with_faults(derived.newick(leaves))).status
    return status.groupBy("status").agg(F.count("*").alias("n_trees"))


@query(LEAVES + " SELECT DISTINCT taxon FROM gene_leaf WHERE tree_id IN (SELECT min(tree_id) FROM gene_leaf UNION SELECT max(tree_id) FROM gene_leaf)")
def taxa_union(spark, sf_dir):
    """Taxa of the first and the last tree together."""
    order = derived_trees(spark, sf_dir).order
    one = lambda f: order.join(F.broadcast(order.agg(f("tree_id").alias("tree_id"))), "tree_id").select("taxon")
    return one(F.min).union(one(F.max)).distinct()


@query(LEAVES + SPLITS + """, w AS (SELECT CAST(sum(CAST(1 AS BIGINT) << taxon) AS BIGINT) AS w FROM (SELECT DISTINCT taxon FROM gene_leaf))
SELECT a, b, a | b AS u, a & b AS both, w & ~(a | b) AS rest, CAST(bit_count(a) AS BIGINT) AS size_a, CAST(bit_count(xor(a, w)) AS BIGINT) AS size_not_a FROM dsplit, w""")
def set_algebra(spark, sf_dir):
    """Union, intersection, complement and sizes of the sides of distinct splits."""
    trees = derived_trees(spark, sf_dir)
    a, b = F.col("a.w0"), F.col("b.w0")
    every = trees.taxa.agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("taxon").cast("int"))).alias("w"))
    rows = trees.splits.join(F.broadcast(every), F.lit(True))
    return rows.select(
        a.alias("a"), b.alias("b"), a.bitwiseOR(b).alias("u"), a.bitwiseAND(b).alias("both"), F.col("w").bitwiseAND(F.bitwise_not(a.bitwiseOR(b))).alias("rest"),
        F.bit_count(a).cast("long").alias("size_a"), F.bit_count(a.bitwiseXOR(F.col("w"))).cast("long").alias("size_not_a"),
    )


@query(LEAVES + SPLITS + OVERLAPS + """, sp AS (SELECT DISTINCT a, b FROM occurrence WHERE tree_id = (SELECT min(tree_id) FROM occurrence))
SELECT CAST(sum(weight) AS BIGINT) AS score FROM sp JOIN weight USING (a, b)""")
def tree_score(spark, sf_dir):
    """Triplets of all gene trees that agree with the first one: the sum of its splits' weights."""
    trees = derived_trees(spark, sf_dir)
    return _first_tree(trees).select("a", "b").join(trees.weights, ["a", "b"]).agg(F.sum("weight").alias("score"))


NODES = """,
leaves AS (SELECT tree_id, count(*) AS k FROM gene_leaf GROUP BY 1),
node AS (SELECT tree_id, CAST(blk << (lvl + 1) AS BIGINT) AS s, CAST(least((blk + 1) << (lvl + 1), k) AS BIGINT) AS e FROM split JOIN leaves USING (tree_id))"""


@query(LEAVES + SPLITS + NODES + " SELECT n.tree_id, n.s AS start_leaf, n.e AS end_leaf, count(a.s) AS n_above FROM node n LEFT JOIN node a ON a.tree_id = n.tree_id AND a.s <= n.s AND a.e >= n.e AND (a.s <> n.s OR a.e <> n.e) GROUP BY 1, 2, 3")
def node_ancestors(spark, sf_dir):
    """How many nodes are above each one: its depth."""
    found = ancestry.depths(derived_trees(spark, sf_dir).nodes)
    return found.select("tree_id", F.col("start").cast("long").alias("start_leaf"), F.col("end").cast("long").alias("end_leaf"), "n_above")


@query(LEAVES + SPLITS + NODES + " SELECT n.tree_id, n.s AS start_leaf, n.e AS end_leaf, a.s AS above_start, a.e AS above_end FROM node n JOIN node a ON a.tree_id = n.tree_id AND a.s <= n.s AND a.e >= n.e AND (a.s <> n.s OR a.e <> n.e)")
def ancestor_pairs(spark, sf_dir):
    """Each node with each node above it."""
    found = ancestry.ancestors(derived_trees(spark, sf_dir).nodes)
    return found.select("tree_id", *(F.col(c).cast("long").alias(k) for c, k in (("start", "start_leaf"), ("end", "end_leaf"), ("above_start", "above_start"), ("above_end", "above_end"))))


@query(LEAVES + SPLITS + NODES + """, pair AS (SELECT x.tree_id, x.pos AS p, y.pos AS q FROM gene_leaf x JOIN gene_leaf y ON x.tree_id = y.tree_id AND y.taxon = (x.taxon + 1) % 25)
SELECT tree_id, p, q, min(e - s) AS size, arg_min(s, e - s) AS start_leaf FROM pair JOIN node USING (tree_id) WHERE s <= least(p, q) AND e > greatest(p, q) GROUP BY 1, 2, 3""")
def lowest_common_nodes(spark, sf_dir):
    """The lowest node above each two taxa with following numbers."""
    trees = derived_trees(spark, sf_dir)
    other = trees.order.select("tree_id", F.pmod(F.col("taxon") + 24, F.lit(25)).alias("taxon"), F.col("pos").alias("q"))
    pairs = trees.order.join(other, ["tree_id", "taxon"]).select("tree_id", F.col("pos").alias("p"), "q")
    found = ancestry.lowest_common(trees.nodes, pairs)
    return found.select("tree_id", "p", "q", (F.col("end") - F.col("start")).cast("long").alias("size"), F.col("start").cast("long").alias("start_leaf"))


#: A tree for each part: its suppliers' nations by their largest price.
PART_LEAVES = """
cell AS (SELECT l_partkey AS tree_id, s_nationkey AS taxon, max(l_extendedprice) AS m FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
gene_leaf AS (SELECT tree_id, taxon, row_number() OVER (PARTITION BY tree_id ORDER BY m DESC, taxon) - 1 AS pos FROM cell)"""


@query(PART_LEAVES + SPLITS + " SELECT a, b, freq FROM dsplit")
def split_frequency_parts(spark, sf_dir):
    """As split_frequency, with as many trees as parts."""
    return derived_trees(spark, sf_dir, parts=True).splits.select(_word("a"), _word("b"), "freq")


@query(PART_LEAVES + SPLITS + TREES + VERSUS + " SELECT tree_id, distance, round(nrf, 6) AS nrf FROM vrf")
def rf_vs_species_parts(spark, sf_dir):
    """Distances of the parts' trees to the first one that has a split."""
    trees = derived_trees(spark, sf_dir, parts=True)
    edges = _edges(trees)
    every = trees.order.select("tree_id")
    found = compare.to_one(edges, every, _first_edges(trees, edges))
    return found.select("tree_id", "distance", F.round(compare.normed(F.col("distance"), trees.taxa.count()), 6).alias("nrf"))


@query(PART_LEAVES + """, t AS (SELECT tree_id, max(CASE WHEN taxon % 7 = 3 THEN 1 ELSE 0 END) AS x FROM gene_leaf GROUP BY 1)
SELECT CASE WHEN x = 1 THEN 'unknown' ELSE 'ok' END AS status, count(*) AS n_trees FROM t GROUP BY 1""")
def unknown_taxa_parts(spark, sf_dir):
    """The parts' trees by status, read with a dictionary that lacks some nations."""
    trees = derived_trees(spark, sf_dir, parts=True)
    status = Collection(trees.lines, taxa=trees.taxa.where("taxon % 7 <> 3")).status
    return status.groupBy("status").agg(F.count("*").alias("n_trees"))


#: A tree for each month of shipping: suppliers by their largest price. Sets are 128-bit numbers here, for up to 126 suppliers.
SUPPLIERS = """
cell AS (SELECT CAST(year(l_shipdate) * 100 + month(l_shipdate) AS INT) AS tree_id, l_suppkey AS taxon, max(l_extendedprice) AS m FROM lineitem GROUP BY 1, 2),
gene_leaf AS (SELECT tree_id, taxon, row_number() OVER (PARTITION BY tree_id ORDER BY m DESC, taxon) - 1 AS pos FROM cell),
sizes AS (SELECT tree_id, count(*) AS k FROM gene_leaf GROUP BY 1),
member AS (SELECT tree_id, lvl, pos >> (lvl + 1) AS blk, (pos >> lvl) & 1 AS side, CAST(1 AS HUGEINT) << CAST(taxon AS HUGEINT) AS m FROM gene_leaf, (SELECT unnest([0, 1, 2, 3, 4, 5, 6]) AS lvl)),
split AS (SELECT tree_id, lvl, blk, bit_or(CASE WHEN side = 0 THEN m ELSE CAST(0 AS HUGEINT) END) AS l, bit_or(CASE WHEN side = 1 THEN m ELSE CAST(0 AS HUGEINT) END) AS r FROM member GROUP BY 1, 2, 3 HAVING count(DISTINCT side) = 2),
occurrence AS (SELECT tree_id, least(l, r) AS a, greatest(l, r) AS b, blk << (lvl + 1) AS s, (blk << (lvl + 1)) + (1 << lvl) AS mid, least((blk + 1) << (lvl + 1), k) AS e FROM split JOIN sizes USING (tree_id)),
dsplit AS (SELECT a, b, count(*) AS freq, min({'t': tree_id, 's': s, 'm': mid, 'e': e}) AS f FROM occurrence GROUP BY 1, 2)"""


_SUPPLIER_WEIGHTS = SUPPLIERS + OVERLAPS + " SELECT f.t AS tree_id, CAST(f.s AS BIGINT) AS first_leaf, CAST(f.m AS BIGINT) AS middle, CAST(f.e AS BIGINT) AS end_leaf, freq, weight FROM weight JOIN dsplit USING (a, b)"


def _supplier_weights(trees: Collection) -> DataFrame:
    at = lambda c, name: F.col(f"first.{c}").cast("long").alias(name)
    return trees.splits.join(trees.weights, ["a", "b"]).select(F.col("first.tree_id").alias("tree_id"), at("start", "first_leaf"), at("mid", "middle"), at("end", "end_leaf"), "freq", "weight")


@query(_SUPPLIER_WEIGHTS)
def supplier_split_weights(spark, sf_dir):
    """Weights where taxa are many, as many as suppliers: sets of several words, or hashes and leaf orders."""
    return _supplier_weights(derived_trees(spark, sf_dir, "supplier"))


@query(_SUPPLIER_WEIGHTS)
def supplier_weights_hashed(spark, sf_dir):
    """The same with hashed sets and along leaf orders, however few suppliers there are."""
    trees = derived_trees(spark, sf_dir, "supplier")
    hashed = Collection(trees.lines, taxa=trees.taxa)
    hashed.words = bits.HASHED
    return _supplier_weights(hashed)


#: Sets around the inner branches of the first tree, by its leaf order, and quartets in all trees, for up to 126 suppliers.
SUPPLIER_QUADS = SUPPLIERS + """,
node AS (SELECT tree_id, l, r, blk << (lvl + 1) AS s, (blk << (lvl + 1)) + (1 << lvl) AS mid, least((blk + 1) << (lvl + 1), k) AS e FROM split JOIN sizes USING (tree_id)),
sp AS (SELECT * FROM node WHERE tree_id = (SELECT min(tree_id) FROM node)),
every AS (SELECT bit_or(CAST(1 AS HUGEINT) << CAST(taxon AS HUGEINT)) AS w FROM gene_leaf),
up AS (SELECT s, mid AS e, mid AS s2, e AS e2, r AS other, l | r AS both FROM sp UNION ALL SELECT mid, e, s, mid, l, l | r FROM sp),
quad AS (SELECT c.s, c.e, c.l AS q1, c.r AS q2, coalesce(b.l, up.other) AS q3, coalesce(b.r, w & ~up.both) AS q4
  FROM sp c JOIN up ON up.s = c.s AND up.e = c.e LEFT JOIN sp b ON b.s = up.s2 AND b.e = up.e2 CROSS JOIN every WHERE coalesce(b.r, w & ~up.both) <> 0),
whole AS (SELECT tree_id, bit_or(CAST(1 AS HUGEINT) << CAST(taxon AS HUGEINT)) AS w FROM gene_leaf GROUP BY 1),
part AS (SELECT q.s, q.e, freq, CAST(bit_count(q1 & a) AS BIGINT) AS al, CAST(bit_count(q1 & b) AS BIGINT) AS ar, CAST(bit_count(q2 & a) AS BIGINT) AS bl, CAST(bit_count(q2 & b) AS BIGINT) AS br,
  CAST(bit_count(q3 & a) AS BIGINT) AS cl, CAST(bit_count(q3 & b) AS BIGINT) AS cr, CAST(bit_count(q4 & a) AS BIGINT) AS dl, CAST(bit_count(q4 & b) AS BIGINT) AS dr FROM quad q, dsplit),
tops AS (SELECT s, e, CAST(sum(freq * (al * bl * cr * dr + ar * br * cl * dl)) AS BIGINT) AS f1, CAST(sum(freq * (al * cl * br * dr + ar * cr * bl * dl)) AS BIGINT) AS f2,
  CAST(sum(freq * (al * dl * br * cr + ar * dr * bl * cl)) AS BIGINT) AS f3 FROM part GROUP BY 1, 2),
ns AS (SELECT s, e, CAST(sum(CAST(bit_count(q1 & w) AS BIGINT) * bit_count(q2 & w) * bit_count(q3 & w) * bit_count(q4 & w)) AS BIGINT) AS n,
  CAST(max(CAST(bit_count(q1) AS BIGINT) * bit_count(q2) * bit_count(q3) * bit_count(q4)) AS BIGINT) AS possible FROM quad, whole GROUP BY 1, 2)"""


@query(SUPPLIER_QUADS + " SELECT CAST(s AS BIGINT) AS first_leaf, CAST(e AS BIGINT) AS end_leaf, f1, f2, f3, n, possible FROM tops JOIN ns USING (s, e)")
def supplier_quartets(spark, sf_dir):
    """Quartets around the branches of the first tree where taxa are many, along the trees' leaf orders."""
    trees = derived_trees(spark, sf_dir, "supplier")
    first = F.broadcast(trees.nodes.agg(F.min("tree_id").alias("tree_id")))
    found = quartets.frequencies_along(trees.nodes.join(first, "tree_id"), trees.order.join(first, "tree_id"), trees.taxa, trees.arrays)
    return found.select(F.col("start").alias("first_leaf"), F.col("end").alias("end_leaf"), *(F.col(c).cast("long").alias(c) for c in ("f1", "f2", "f3", "n", "possible")))

"""Newick text: reading files of trees, cleaning lines, and parsing them."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeworks.operators.blocks import limited
from cladeworks.session import settle

#: Bytes of the lines that a task parses together, or one line (some 80 bytes are held for each).
AT_ONCE = 1 << 21


def read_lines(spark: SparkSession, path: str, first: int | None = None) -> DataFrame:
    """tree_id, newick of the non-blank lines of a text file; ids ascend with the lines. ``first``: only so many lines.

    A bound counts lines before any is checked for validity.
    """
    rows = spark.read.text(path).where(F.trim("value") != "").select(F.monotonically_increasing_id().alias("tree_id"), F.col("value").alias("newick"))
    return rows if first is None else rows.orderBy("tree_id").limit(first)


def read_tree_files(spark: SparkSession, path: str, pattern: str = "g_trees*.trees") -> DataFrame:
    """One tree a file, below ``path``, numbered by the last number in the file's name; ``replicate`` is the folder's name.

    Comments and line ends go, the line ends with a semicolon, and the folder's number loses leading zeros.
    """
    rows = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(path, wholetext=True)
    rows = rows.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_name").alias("name"))
    folder = F.regexp_replace(F.regexp_extract("file", "([^/]+)/[^/]+$", 1), r"^0+(?=\d)", "")
    number = F.regexp_extract("name", r"(\d+)[^\d]*$", 1).cast("long")
    return rows.select(folder.alias("replicate"), number.alias("tree_id"), one_line(F.col("value")).alias("newick"))


def one_line(text: Column) -> Column:
    """Without bracketed comments and line ends, with one semicolon at the end."""
    bare = F.regexp_replace(F.regexp_replace(text, r"\[[^\]]*\]", ""), r"[\r\n]", "")
    return F.concat(F.regexp_replace(F.trim(bare), ";+$", ""), F.lit(";"))


def reorganize(spark: SparkSession, root: str, out: str, mode: str = "ignore") -> list[str]:
    """Replicates ``root``/N with both all_gt.tre and s_tree.trees, as ``out``/all_gt and ``out``/s_tree, partitioned by replicate=RN.

    Gene trees lose the suffix of their labels; nothing is deleted. Returns the replicates, in the order of their numbers.
    """
    gene, species = (spark.read.option("pathGlobFilter", name).option("recursiveFileLookup", "true").text(root).select("value", F.regexp_extract(F.col("_metadata.file_path"), "/([0-9]+)/[^/]+$", 1).alias("n")).where("n <> ''") for name in ("all_gt.tre", "s_tree.trees"))
    both = settle(gene.select("n").distinct().join(species.select("n").distinct(), "n").select("n", F.concat(F.lit("R"), "n").alias("replicate")), "replicates")
    for rows, name, value in ((gene, "all_gt", drop_label_suffix(F.col("value"))), (species, "s_tree", F.col("value"))):
        rows.join(F.broadcast(both), "n").select(value.alias("value"), "replicate").write.mode(mode).partitionBy("replicate").text(f"{out}/{name}")
    return [r.replicate for r in both.orderBy(F.col("n").cast("long")).toLocalIterator()]


def drop_label_suffix(newick: Column, suffix: str = "_0_0") -> Column:
    return F.replace(newick, F.lit(suffix), F.lit(""))


def write_newick(trees: DataFrame, path: str, mode: str = "error") -> None:
    """A text file of the column newick; ``mode`` 'ignore' leaves a result that is there."""
    trees.select("newick").coalesce(1).write.mode(mode).text(path)


class Parsed(NamedTuple):
    """trees: tree_id, labels of the leaves in order, start, mid, end of the nodes as arrays, of accepted lines; status of all: tree_id, status ('ok' or why not), n_leaves."""

    trees: DataFrame
    status: DataFrame


def leaves(trees: DataFrame) -> DataFrame:
    """tree_id, pos, label of each leaf."""
    return trees.select("tree_id", F.posexplode("labels").alias("pos", "label"))


SHAPE = "labels array<string>, start array<bigint>, mid array<bigint>, end array<bigint>, n_leaves bigint, open bigint, ends bigint, internal boolean, misplaced boolean, paired boolean, binary boolean, roots bigint, root_start bigint, root_end bigint"

OPEN, CLOSE, COMMA, STOP, LABEL, NOTHING = *b"(),;", 0, 255


class Tokens(NamedTuple):
    """The tokens of many lines one after the other: line, kind (OPEN and so on), and the bytes of labels."""

    line: np.ndarray
    kind: np.ndarray
    start: np.ndarray
    end: np.ndarray


def tokens(text: np.ndarray, offsets: np.ndarray) -> Tokens:
    """Cuts the bytes of lines (the n-th from offsets[n] to offsets[n + 1]) at brackets, commas and semicolons."""
    at = np.flatnonzero((text == OPEN) | (text == CLOSE) | (text == COMMA) | (text == STOP))
    # marks, and the ends of lines, which come before a mark at the same place
    place, is_mark = np.concatenate([offsets[1:], at]), np.repeat([False, True], [len(offsets) - 1, len(at)])
    order = np.lexsort((is_mark, place))
    place, is_mark = place[order], is_mark[order]
    begin = np.concatenate([offsets[:1], np.where(is_mark, place + 1, place)[:-1]])  # of what stands before a mark or end
    line = np.cumsum(~is_mark) - ~is_mark
    labelled = place > begin
    own = np.cumsum(labelled.astype(np.int64) + is_mark)
    n = int(own[-1]) if len(own) else 0
    out = Tokens(*(np.zeros(n, k) for k in (np.int64, np.uint8, np.int64, np.int64)))
    for there, spot, kind in ((labelled, own - 1 - is_mark, LABEL), (is_mark, own - 1, None)):
        i = spot[there]
        out.line[i], out.start[i], out.end[i] = line[there], begin[there], place[there]
        out.kind[i] = text[place[there]] if kind is None else kind
    return out


def _upto(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Running sums that begin anew where ``first`` is set."""
    total = np.cumsum(values)
    starts = np.flatnonzero(first)
    base = (total - values)[starts]
    return total - np.repeat(base, np.diff(np.append(starts, len(values)))) if len(values) else total


def shapes(text: np.ndarray, offsets: np.ndarray) -> dict[str, object]:
    """The columns of SHAPE for lines of bytes, by running sums over all their tokens: no tree is built, a node is an interval of leaf places.

    A node is the n-th bracket opened at its depth, with the comma and the closing bracket of that depth that follow.
    """
    n, t = len(offsets) - 1, tokens(text, offsets)
    first = np.concatenate([[True], t.line[1:] != t.line[:-1]])[: len(t.line)]
    before = np.where(first, NOTHING, np.concatenate([[NOTHING], t.kind[:-1]])[: len(t.kind)])
    is_in = lambda x, *kinds: np.isin(x, kinds)
    opens, closes = (t.kind == OPEN).astype(np.int64), (t.kind == CLOSE).astype(np.int64)
    internal = (t.kind == LABEL) & (before == CLOSE)
    leaf = (t.kind == LABEL) & ~internal
    bad = (leaf & (before == STOP)) | ((opens == 1) & ~is_in(before, NOTHING, OPEN, COMMA)) | (is_in(t.kind, COMMA, CLOSE, STOP) & is_in(before, OPEN, COMMA, NOTHING, STOP))
    depth = _upto(opens - closes, first) + closes
    place = _upto(leaf.astype(np.int64), first)

    i = np.flatnonzero(is_in(t.kind, OPEN, COMMA, CLOSE))
    i = i[np.lexsort((depth[i], t.line[i]))]  # stable: tokens of a depth stay in order
    level = np.concatenate([[True], (t.line[i][1:] != t.line[i][:-1]) | (depth[i][1:] != depth[i][:-1])])[: len(i)]
    number = _upto(opens[i], level)
    node = level | np.concatenate([[True], number[1:] != number[:-1]])[: len(i)]
    at = np.flatnonzero(node)
    of = lambda kind: t.kind[i] == kind
    count = lambda kind: np.add.reduceat(of(kind).astype(np.int64), at) if len(at) else np.zeros(0, np.int64)
    last = lambda kind: np.maximum.reduceat(np.where(of(kind), place[i], -1), at) if len(at) else np.zeros(0, np.int64)
    start, mid, end = map(last, (OPEN, COMMA, CLOSE))
    line, top = t.line[i][at], depth[i][at] == 1
    lines = lambda which, weight=None: np.bincount(which, weight, n).astype(np.int64)
    paired = lines(line[(count(OPEN) != 1) | (count(CLOSE) != 1)]) == 0
    binary = lines(line[count(COMMA) != 1]) == 0
    root_start, root_end = np.full(n, -1), np.full(n, -1)
    root_start[line[top]], root_end[line[top]] = start[top], end[top]
    good = (paired & binary)[line]
    some = lambda which: lines(t.line[which]) > 0
    return {
        "nodes": (line[good], start[good], mid[good], end[good]), "leaves": (t.line[leaf], t.start[leaf], t.end[leaf]), "n_leaves": lines(t.line[leaf]), "open": lines(t.line, opens - closes), "ends": lines(t.line[t.kind == STOP]),
        "internal": some(internal), "misplaced": some(bad), "paired": paired, "binary": binary, "roots": lines(line[top]), "has_nodes": lines(line) > 0, "root_start": root_start, "root_end": root_end,
    }


def _shapes(batches):
    import pyarrow as pa

    def cut(line, values, n):
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(line, minlength=n))]).astype(np.int32)), values)

    for b in limited(batches, "text", AT_ONCE):
        column = b.column("text").cast(pa.large_string())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        text = np.frombuffer(column.buffers()[2] or b"", np.uint8)
        x, n = shapes(text, offsets), b.num_rows
        line, *ends = x["leaves"]
        sizes = ends[1] - ends[0]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        taken = text[np.repeat(ends[0] - upto[:-1], sizes) + np.arange(upto[-1])]
        labels = pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(upto.astype(np.int64).tobytes()), pa.py_buffer(taken.tobytes())).cast(pa.string())
        of, *spans = x["nodes"]
        columns = [cut(line, labels, n), *(cut(of, pa.array(v), n) for v in spans)]
        columns += [pa.array(x[c]) for c in ("n_leaves", "open", "ends", "internal", "misplaced", "paired", "binary")]
        columns += [pa.array(x["roots"], mask=~x["has_nodes"]), *(pa.array(x[c], mask=x["roots"] == 0) for c in ("root_start", "root_end"))]
        yield pa.record_batch([b.column("tree_id"), *columns], names=["tree_id", *(c.split()[0] for c in SHAPE.split(", "))])


def shaped(lines: DataFrame) -> DataFrame:
    """tree_id and the columns of SHAPE for (tree_id, newick) lines that are not blank: one pass, so streams will do as well."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace("newick", r"\[[^\]]*\]", ""), r"\s", ""), ":[^,();]*", "")
    rows = lines.where(F.trim("newick") != "").select("tree_id", text.alias("text")).where("text <> ''")
    return rows.mapInArrow(_shapes, f"tree_id {dict(lines.dtypes)['tree_id']}, {SHAPE}")


def status_of(internal_labels: str, strange: Column) -> Column:
    """'ok', or why a line of ``shaped`` is no tree; ``strange`` tells that a leaf is not in the dictionary."""
    whole = (F.col("roots") == 1) & (F.col("root_start") == 0) & (F.col("root_end") == F.col("n_leaves")) & F.col("paired")
    return (
        F.when((F.col("open") != 0) | (F.col("ends") > 1), "unbalanced")
        .when(F.col("internal") & F.lit(internal_labels == "reject"), "label")
        .when(F.col("n_leaves") == 0, "label")
        .when(F.col("roots").isNull(), F.when((F.col("n_leaves") == 1) & ~F.col("misplaced"), F.when(strange, "unknown").otherwise("ok")).otherwise("unbalanced"))
        .when(~whole, "unbalanced")
        .when(~F.col("binary"), "not_binary")
        .when(F.col("misplaced"), "label")
        .when(strange, "unknown")
        .when(F.size(F.array_distinct("labels")) < F.col("n_leaves"), "duplicate")
        .otherwise("ok")
    )


def parse(lines: DataFrame, internal_labels: str = "ignore", taxa: DataFrame | None = None) -> Parsed:
    """Parse (tree_id, newick) lines, in one pass over their bytes and without a shuffle; what is found is written at once.

    Accepted are rooted binary trees, one a line, with or without lengths, comments and a semicolon, and single
    leaves. Null and blank lines are passed over. A label after ``)`` is a support value, which is ignored, or makes
    the tree unfit (``internal_labels='reject'``). Not accepted, with their status: ``label`` (empty, or internal),
    ``duplicate`` labels, ``unbalanced`` or surplus parts, ``not_binary``; and ``unknown`` if a dictionary ``taxa``
    (label) is given and a leaf is not in it.
    """
    found = settle(shaped(lines), "parsed")
    found = found.withColumn("strange", F.lit(False))
    if taxa is not None:
        strange = leaves(found).join(taxa.select("label"), "label", "left_anti").select("tree_id").distinct()
        found = found.drop("strange").join(strange.withColumn("strange", F.lit(True)), "tree_id", "left")
    found = found.withColumn("status", status_of(internal_labels, F.coalesce("strange", F.lit(False))))
    return Parsed(found.where("status = 'ok'").select("tree_id", "labels", "start", "mid", "end"), found.select("tree_id", "status", "n_leaves"))

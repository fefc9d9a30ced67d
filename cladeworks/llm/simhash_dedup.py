"""Near-duplicates by SimHash: Golay-code keys of fingerprint segments, joined, verified, and linked to components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeworks.llm.common import few, in_groups, small, table, texts
from cladeworks.llm.components import components
from cladeworks.session import settle

WORDS, RADIUS = 4, 4
#: First bit and width of each segment of a fingerprint. A pair of segments holds at most 2 of 4 differing bits.
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: Groups of more rows than this are searched breadth first; rows that a task gathers before it compares them.
SMALL, BATCH = 48, 100_000
#: Most groups, or rows to be dropped (16 bytes each), that are broadcast; more are joined by a shuffle.
MOST_GONE = 1_000_000


def fingerprint(text: bytes) -> int:
    """64 bits, each set if it is in over half of the XXH64 (seed 42) of the text's 4-word shingles.

    A-Z count as lower case; shingles that repeat count each time; fewer words: all of them; none: 0.
    """
    import numpy as np
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - WORDS + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    ends = ends[min(WORDS, len(words)) - 1 :].tolist()
    digest, seen = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for i in range(0, n, 1 << 15):
        h = np.array([digest(joined[a:b], 42) for a, b in zip(starts[i : i + (1 << 15)], ends[i : i + (1 << 15)], strict=True)], "<u8")
        seen += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits(2 * seen > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches):
    import numpy as np
    import pyarrow as pa

    from cladeworks.llm.common import raw

    for b in few(batches):
        found = np.array([fingerprint(t) for t in raw(b.column("text"))], np.uint64).view(np.int64)
        yield pa.record_batch({c: b.column(c) for c in b.schema.names if c != "text"} | {"fp": pa.array(found)})


def _keys(batches):
    """Rows (key, fp): for each pair of segments, one's own codeword index with the other's nearby ones, both ways."""
    import numpy as np
    import pyarrow as pa

    from cladeworks.llm import golay

    for b in batches:
        fp = np.ascontiguousarray(b.column("fp").to_numpy()).view(np.uint64)
        parts = [((fp >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
        own, near = [golay.decode(x) for x in parts], [golay.nearby(x, n) for x, (_, n) in zip(parts, SEGMENTS, strict=True)]
        keys, at = [], []
        for number, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
            base = number << 24
            r, c = np.nonzero(near[j] >= 0)
            keys.append(base | own[i][r] << 12 | near[j][r, c])
            at.append(r)
            r, c = np.nonzero((near[i] >= 0) & (near[i] != own[i][:, None]))
            keys.append(base | near[i][r, c] << 12 | own[j][r])
            at.append(r)
        yield pa.record_batch({"key": pa.array(np.concatenate(keys).astype(np.int32)), "fp": pa.array(fp[np.concatenate(at)].view(np.int64))})


def _spread(fp, near):
    """The first row of each row's component, by a search that tests open rows only."""
    import numpy as np

    label, left = np.arange(len(fp)), np.arange(len(fp))
    while len(left):
        first, wave, left = left[0], left[:1], left[1:]
        while len(wave) and len(left):
            row, wave = wave[0], wave[1:]
            hit = near(fp[left], fp[row])
            label[left[hit]] = first
            wave, left = np.concatenate([wave, left[hit]]), left[~hit]
    return label


def link_groups(key, fp):
    """Links (u, v) that join the rows of each run of equal keys that are within the radius: a star for each component."""
    import numpy as np

    near = lambda a, b: np.bitwise_count(a ^ b) <= RADIUS
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(key)]]))
    label = np.arange(len(key))
    for s, n in zip(starts[sizes > SMALL], sizes[sizes > SMALL], strict=True):
        label[s : s + n] = s + _spread(fp[s : s + n], near)
    rows = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= SMALL), sizes))
    a, b = [], []
    for d in range(1, SMALL):
        rows = rows[rows + d < len(key)]
        rows = rows[key[rows] == key[rows + d]]
        if not len(rows):
            break
        hit = rows[near(fp[rows], fp[rows + d])]
        a.append(hit)
        b.append(hit + d)
    if a:
        a, b = np.concatenate(a), np.concatenate(b)
        while (label[a] != label[b]).any():
            np.minimum.at(label, b, label[a])
            np.minimum.at(label, a, label[b])
    moved = np.flatnonzero(label != np.arange(len(key)))
    return np.unique(np.stack([fp[moved], fp[label[moved]]], 1), axis=0) if len(moved) else np.zeros((0, 2), np.uint64)


def _links(batches):
    """Verified links of each run of equal groups; the last run of a batch may go on in the next."""
    import numpy as np
    import pyarrow as pa

    def out(parts):
        g, fp = (np.concatenate(x) for x in zip(*parts, strict=True))
        pairs = link_groups(g, fp).view(np.int64)
        return pa.record_batch({"u": pa.array(pairs[:, 0]), "v": pa.array(pairs[:, 1])})

    held, size = [], 0
    for b in batches:
        g, fp = b.column("g").to_numpy(), np.ascontiguousarray(b.column("fp").to_numpy()).view(np.uint64)
        if size >= BATCH and len(g):  # a group has a bounded number of rows, so what is held is bounded too
            end = int(np.flatnonzero(np.append(g != held[-1][0][-1], True))[0])
            held.append((g[:end], fp[:end]))
            if end < len(g):
                yield out(held)
                held, size = [], 0
            g, fp = g[end:], fp[end:]
        if len(g):
            held.append((g, fp))
            size += len(g)
    if held:
        yield out(held)


def near_duplicates(docs: DataFrame, *more: str | Column) -> DataFrame:
    """doc_id, the columns in ``more``, fp and component_id, the smallest doc_id that links lead to, for each row of ``docs``.

    Two fingerprints link if at most 4 bits differ. Texts without a word (null, empty) have fingerprint 0 and link
    like any other. Copies are one fingerprint from the start. Each distinct fingerprint gives about 30 keys; rows
    with one key are compared in groups of bounded size: a key with more rows is dealt to parts, each two of which
    meet in a group of their own. A group passes on a star for each component it sees, never all pairs. Null doc_ids
    get the component of their text (null if no row of it has an id); repeated rows get a result each; an empty table
    gives none; other columns are left behind.
    """
    marked = settle(texts(docs, *more).mapInArrow(_fingerprints, _schema(docs, more)), "fingerprints")
    return _grouped(marked)


def _schema(docs: DataFrame, more) -> str:
    kinds = [f"`{c}` {k}" for c, k in texts(docs, *more).dtypes if c != "text"]
    return ", ".join([*kinds, "fp long"])


def _grouped(marked: DataFrame) -> DataFrame:
    distinct = settle(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    keyed = in_groups(distinct.select("fp").mapInArrow(_keys, "key int, fp long"), "fp")
    roots = components(keyed.select("g", "fp").mapInArrow(_links, "u long, v long"))
    of = settle(distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "roots")
    least = settle(of.groupBy("root").agg(F.min("first").alias("component_id")), "least")
    named = settle(of.join(least, "root").select("fp", "component_id", F.col("root").alias("component")), "named")
    return marked.join(named, "fp").select(*(c for c in marked.columns if c != "fp"), "fp", "component_id", "component")


def drop_near_duplicates(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text (null: empty) and the columns in ``more`` of one row of each group of linked rows of ``docs``.

    It is the row with the smallest doc_id (null last), of those the one whose text has the smallest hash, and of
    rows with that doc_id and text one with the smallest values in ``more``. So what stays depends on the rows alone,
    not on their partitions or on tasks that ran twice; rows of one doc_id with different texts are judged each for
    itself, and copies without an id go like others. An empty table gives none. Texts are not shuffled, unless over
    MOST_GONE of them go.
    """
    found = settle(near_duplicates(docs, F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")), "members")
    row = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("text_hash").alias("h"))
    groups = found.groupBy("component").agg(F.min(row).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    members = found.join(small(groups, MOST_GONE, "groups"), "component").select("doc_id", "text_hash", (row == F.col("first")).alias("is_first"))
    gone = small(members.where("not is_first").select("doc_id", "text_hash").distinct(), MOST_GONE, "gone")
    again = small(members.where("is_first").groupBy("doc_id", "text_hash").count().where("count > 1").drop("count"), MOST_GONE, "again")
    rows = texts(docs, *more).withColumn("text_hash", F.xxhash64("text"))
    is_in = lambda other: rows["doc_id"].eqNullSafe(other["doc_id"]) & (rows["text_hash"] == other["text_hash"])
    kept = rows.join(gone, is_in(gone), "left_anti")
    if not again.isEmpty():
        once = kept.join(again, is_in(again), "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct(F.lit(0).alias("_"), *more)).alias("x"))
        kept = kept.join(again, is_in(again), "left_anti").select("doc_id", "text", *more).unionByName(once.select("doc_id", "text", *(F.col(f"x.{c}").alias(c) for c in more)))
    return kept.select("doc_id", "text", *more)


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; cases as in ``near_duplicates``."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

"""Trie of conversations by vertical bitmaps: (position, turn) to bitsets of conversations, intersected depth first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cladeworks.llm.common import table
from cladeworks.llm.conversations import CRC_SQL, DIGEST_SQL, WORD, WORDS_SQL, digest, turns
from cladeworks.session import settle

#: A shard ends with the conversation that brings it to so many conversations or turns.
SHARD, SHARD_TURNS = 2048, 100_000
#: Conversations of a block, the first of which lends the others their first turns; the most that it lends, and one.
BLOCK, LENT = 20, 4

TRIE = "shard long, number int, depth long, key binary, parent binary, words long, n long, least long, n_ends long, ends string"


class Bitmaps:
    """The index of a shard: for each position and turn the conversations that have it there, as the bits of an integer."""

    def __init__(self, ids: list[int], paths: list[list[tuple[bytes, int]]]):
        """``ids`` ascend; ``paths`` has the turns of each conversation, (digest, words)."""
        self.ids, self.paths = ids, paths
        self.postings: dict[tuple[int, bytes], int] = {}
        self.ended: dict[int, int] = {}
        for slot, path in enumerate(paths):
            bit = 1 << slot
            for at in ((i, turn) for i, (turn, _) in enumerate(path)):
                self.postings[at] = self.postings.get(at, 0) | bit
            self.ended[len(path)] = self.ended.get(len(path), 0) | bit

    def walk(self):
        """depth, key, parent's key, words of the last turn, bitset of members, bitset of those that end, of each node; tops first."""
        import xxhash

        todo = [(0, b"\0" * 16, None, 0, (1 << len(self.ids)) - 1)]
        while todo:
            depth, key, parent, words, members = todo.pop()
            ends = members & self.ended.get(depth, 0)
            yield depth, key, parent, words, members, ends
            rest, children = members ^ ends, []
            while rest:
                turn, n = self.paths[(rest & -rest).bit_length() - 1][depth]
                child = members & self.postings[depth, turn]
                children.append((depth + 1, xxhash.xxh3_128_digest(key + turn), key, n, child))
                rest &= ~child
            todo += reversed(children)

    def names(self, bits: int) -> list[int]:
        out = []
        while bits:
            low = bits & -bits
            out.append(self.ids[low.bit_length() - 1])
            bits ^= low
        return out


def _tries(batches):
    """The nodes of each shard of a partition that is sorted by conversation, part and place."""
    import pyarrow as pa

    fields = [("shard", pa.int64()), ("number", pa.int32()), ("depth", pa.int64()), ("key", pa.binary()), ("parent", pa.binary()), ("words", pa.int64()), ("n", pa.int64()), ("least", pa.int64()), ("n_ends", pa.int64()), ("ends", pa.string())]
    ids, paths, size = [], [], 0

    def out():
        index, rows = Bitmaps(ids, paths), []
        for number, (depth, key, parent, words, members, ends) in enumerate(index.walk()):
            done = index.names(ends)
            rows.append((ids[0], number, depth, key, parent, words, members.bit_count(), ids[(members & -members).bit_length() - 1], len(done), ",".join(map(str, done)) if done else None))
            if len(rows) == 10_000:
                yield pa.record_batch([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], names=[f for f, _ in fields])
                rows = []
        if rows:
            yield pa.record_batch([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], names=[f for f, _ in fields])

    for b in batches:
        for conv, turn, words in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn_key", "words")), strict=True):
            if not ids or ids[-1] != conv:
                if len(ids) >= SHARD or size >= SHARD_TURNS:
                    yield from out()
                    ids, paths, size = [], [], 0
                ids.append(conv)
                paths.append([])
            if turn is not None:
                paths[-1].append((turn, words))
                size += 1
    if ids:
        yield from out()


def _subtrees(batches):
    """key, n_leaves, saved_tokens of each shard's nodes, summed over what is below them; rows come by shard, tops first."""
    import pyarrow as pa

    done, open_nodes, shard = [], [], None  # open: depth, key, leaves, saved

    def close(depth: int):
        while open_nodes and open_nodes[-1][0] >= depth:
            _, key, leaves, saved = open_nodes.pop()
            done.append((key, leaves, saved))
            if open_nodes:
                open_nodes[-1][2] += leaves
                open_nodes[-1][3] += saved

    def out():
        columns = list(zip(*done, strict=True)) or [(), (), ()]
        done.clear()
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, (pa.binary(), pa.int64(), pa.int64()), strict=True)], names=["key", "n_leaves", "saved_tokens"])

    for b in batches:
        for s, depth, key, leaf, saved in zip(*(b.column(c).to_pylist() for c in ("shard", "depth", "key", "leaf", "saved")), strict=True):
            close(0 if s != shard else depth)
            shard = s
            open_nodes.append([depth, key, leaf, saved])
        yield out()
    close(0)
    yield out()


def _end_hashes(batches):
    """key, ends_sha256 of the ids that end at a node, which come by node and in ascending parts."""
    import hashlib

    import pyarrow as pa

    key, now, done = None, None, []

    def out():
        columns = list(zip(*done, strict=True)) or [(), ()]
        done.clear()
        return pa.record_batch([pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.string())], names=["key", "ends_sha256"])

    for b in batches:
        for k, ends in zip(b.column("key").to_pylist(), b.column("ends").to_pylist(), strict=True):
            if k == key:
                now.update(b",")
            else:
                if now:
                    done.append((key, now.hexdigest()))
                key, now = k, hashlib.sha256()
            now.update(ends.encode())
        yield out()
    if now:
        done.append((key, now.hexdigest()))
    yield out()


def tries(rows: DataFrame) -> DataFrame:
    """The nodes of each shard's trie, as TRIE tells, for rows (conv_id, part, place, turn_key, words).

    Every conversation has at least one row; one without a turn_key is no turn. Shards are ranges of conversations;
    number is a node's place in its shard, tops first, and ends the ids that end there, ascending and comma-joined.
    """
    dealt = rows.repartitionByRange("conv_id").sortWithinPartitions("conv_id", "part", "place")
    return dealt.select("conv_id", "turn_key", "words").mapInArrow(_tries, TRIE)


def prefix_trie(rows: DataFrame) -> DataFrame:
    """key, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of each node; rows as in ``tries``.

    Each shard of consecutive conversations has its own bitmaps and trie. A node is known by the hash of its path, and
    what is counted of it is added over shards, so a node that all conversations share has a row for each shard, not for
    each conversation. Sums over subtrees are made inside a shard, where the shard that has a node first (it holds the
    smallest member) counts it as a node; the sums of shards add up. A task holds one shard: its turns' hashes, not
    their texts, and at least one whole conversation. An empty table gives no node.
    """
    found = settle(tries(rows), "tries")
    nodes = found.groupBy("key").agg(F.min("least").alias("conv_id"), F.max("depth").alias("depth"), F.max("parent").alias("parent"), F.sum("n").alias("n_convs"), F.sum("n_ends").alias("n_ends"))
    nodes = settle(nodes, "nodes")
    mine = found.join(nodes.select("key", "conv_id", (F.col("n_convs") == F.col("n_ends")).alias("childless")), "key")
    first = (F.col("least") == F.col("conv_id")).cast("long")
    mine = mine.select("shard", "number", "depth", "key", (first * F.col("childless").cast("long")).alias("leaf"), ((F.col("n") - first) * F.col("words")).alias("saved"))
    sums = mine.repartition("shard").sortWithinPartitions("shard", "number").mapInArrow(_subtrees, "key binary, n_leaves long, saved_tokens long")
    ends = found.where("ends is not null").select("key", "shard", "ends").repartition("key").sortWithinPartitions("key", "shard").mapInArrow(_end_hashes, "key binary, ends_sha256 string")
    none = lambda k: F.lit(None).cast(k)
    columns = {"conv_id": "long", "depth": "long", "parent": "binary", "n_convs": "long", "n_children": "long", "n_leaves": "long", "saved_tokens": "long", "ends_sha256": "string"}
    facts = [nodes, nodes.where("parent is not null").select(F.col("parent").alias("key"), F.lit(1).cast("long").alias("n_children")), sums, ends]
    every = [df.select("key", *(F.col(c) if c in df.columns else none(k).alias(c) for c, k in columns.items())) for df in facts]
    total = {c: (F.sum if c in ("n_children", "n_leaves", "saved_tokens") else F.max)(c).alias(c) for c in columns}
    whole = every[0].unionByName(every[1]).unionByName(every[2]).unionByName(every[3]).groupBy("key").agg(*total.values())
    whole = whole.join(nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "parent", "left")
    return whole.select("key", "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, part, place, turn_key, words: the turns of each conversation that begins like the first one of its block.

    A conversation c takes the first h turns of c - c % 20 (all if there are fewer; none if there is no such one), then
    its own after its first h, h being crc32 of c in decimal, modulo 4. Turns are in the order of turn (null first), rows
    of one turn in that of role and hash. A null role or text is empty; rows without a conv_id are left out; repeated
    rows are turns of their own. Each conversation has a first row without a turn (part -1).
    """
    rows = turns(conversations, "").where("conv_id is not null").select("conv_id", "turn", "role", digest().alias("d"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "d")
    rows = settle(rows.select("conv_id", F.row_number().over(order).cast("long").alias("place"), F.unhex("d").alias("turn_key"), "words"), "turns")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % LENT).alias("h")
    all_ids = rows.where("place = 1").select("conv_id", h)
    own = rows.select("*", h).where((F.col("place") > F.col("h")) | (F.col("conv_id") % BLOCK == 0)).select("conv_id", F.lit(1).alias("part"), "place", "turn_key", "words")
    lender = rows.where((F.col("place") < LENT) & (F.col("conv_id") % BLOCK == 0)).select(F.col("conv_id").alias("lender"), "place", "turn_key", "words")
    takers = all_ids.where((F.col("conv_id") % BLOCK != 0) & (F.col("h") > 0)).withColumn("lender", F.col("conv_id") - F.col("conv_id") % BLOCK)
    lent = takers.join(lender, "lender").where("place <= h").select("conv_id", F.lit(0).alias("part"), "place", "turn_key", "words")
    marks = all_ids.select("conv_id", F.lit(-1).alias("part"), F.lit(0).cast("long").alias("place"), F.lit(None).cast("binary").alias("turn_key"), F.lit(0).cast("long").alias("words"))
    return marks.unionByName(lent).unionByName(own)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the trie of all rebuilt conversations; cases as in ``rebuilt`` and ``prefix_trie``."""
    return prefix_trie(rebuilt(table(spark, sf_dir, "conversations"))).drop("key")


OP11_SQL = f"""
WITH plain AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, {DIGEST_SQL}) AS place, {DIGEST_SQL} AS d, {WORDS_SQL.format('text')} AS words FROM plain),
conv AS (SELECT conv_id, {CRC_SQL.format('CAST(conv_id AS VARCHAR)')} % 4 AS h FROM (SELECT DISTINCT conv_id FROM plain)),
path AS (SELECT c.conv_id, 0 AS part, place, d, words FROM conv c JOIN turns t ON t.conv_id = c.conv_id - c.conv_id % 20 AND place <= h
  UNION ALL SELECT c.conv_id, 1, place, d, words FROM conv c JOIN turns t ON t.conv_id = c.conv_id AND place > h),
step AS (SELECT conv_id, row_number() OVER w AS depth, md5(string_agg(d, '') OVER w) AS key, words FROM path WINDOW w AS (PARTITION BY conv_id ORDER BY part, place)),
occurrence AS (SELECT conv_id, 0 AS depth, '' AS key, CAST(NULL AS VARCHAR) AS parent, 0 AS words FROM conv
  UNION ALL SELECT conv_id, depth, key, coalesce(lag(key) OVER (PARTITION BY conv_id ORDER BY depth), ''), words FROM step),
node AS (SELECT key, min(conv_id) AS conv_id, max(depth) AS depth, max(parent) AS parent, max(words) AS words, count(*) AS n_convs FROM occurrence GROUP BY key),
child AS (SELECT parent AS key, count(*) AS n FROM node WHERE parent IS NOT NULL GROUP BY 1),
ends AS (SELECT key, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS hash FROM (SELECT conv_id, arg_max(key, depth) AS key FROM occurrence GROUP BY 1) GROUP BY 1),
below AS (SELECT o.key, sum(CASE WHEN c.n IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((v.n_convs - 1) * v.words) AS saved
  FROM node v JOIN occurrence o ON o.conv_id = v.conv_id AND o.depth <= v.depth LEFT JOIN child c ON c.key = v.key GROUP BY 1)
SELECT v.conv_id, CAST(v.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, v.n_convs, CAST(coalesce(c.n, 0) AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
  CAST(saved AS BIGINT) AS saved_tokens, coalesce(hash, sha256('')) AS ends_sha256
FROM node v LEFT JOIN node p ON p.key = v.parent LEFT JOIN child c ON c.key = v.key JOIN below b ON b.key = v.key LEFT JOIN ends e ON e.key = v.key"""

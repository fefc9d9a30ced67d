"""Drop lines found in many documents: a sharded minimal perfect hash over all distinct lines, to which documents send probes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeworks.llm.common import SPACE, few, raw, table, texts
from cladeworks.session import settle

#: Keys of a shard, and probes of a shard that one task answers: shards with more are copied to several tasks.
SHARD_KEYS, PROBES = 1 << 16, 1 << 20
#: Distinct hashes that a counting task holds before it passes them on.
HELD = 1 << 19
#: Most marked texts, and marks, that are broadcast to the texts; more are joined by a shuffle.
MOST_TEXTS, MOST_MARKS = 500_000, 4_000_000
#: Probes of a batch that are answered at a time.
ANSWERS = 20_000


def line_key(line: bytes) -> bytes:
    """The line without white space at its ends, A-Z in lower case."""
    return line.strip(SPACE).lower()


def _keys(lines: list[bytes]) -> dict[bytes, list[int]]:
    """The 128-bit hash of each different key of a text's lines, and the places of these lines."""
    import xxhash

    places: dict[bytes, list[int]] = {}
    for i, line in enumerate(lines):
        if key := line_key(line):
            places.setdefault(key, []).append(i)
    return {xxhash.xxh3_128_digest(k): at for k, at in places.items()}


def _halves(keys: list[bytes]):
    import numpy as np

    both = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _count(batches):
    """Documents of each line hash, summed within the task."""
    import numpy as np
    import pyarrow as pa

    held: dict[bytes, int] = {}

    def out():
        a, b = _halves(list(held))
        return pa.record_batch({"a": pa.array(a), "b": pa.array(b), "n": pa.array(np.fromiter(held.values(), np.int64, len(held)))})

    for batch in few(batches):
        for text in raw(batch.column("text")):
            for key in _keys(text.split(b"\n")):
                held[key] = held.get(key, 0) + 1
            if len(held) >= HELD:
                yield out()
                held.clear()
    if held:
        yield out()


def line_counts(docs: DataFrame) -> DataFrame:
    """Number of documents (rows of ``docs``) that hold each line key, by the key's 128-bit hash (a, b)."""
    return texts(docs).select("text").mapInArrow(_count, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def _build(rows):
    import numpy as np
    import pyarrow as pa

    from cladeworks.llm.perfect_hash import Shard

    a, b, n = (np.ascontiguousarray(rows[c].to_numpy()) for c in "abn")
    data = Shard.build(a.view(np.uint64), b.view(np.uint64), n).dump()
    return pa.table({"shard": rows["shard"][:1], "n": pa.array([int(n.sum())], pa.int64()), "data": pa.array([data], pa.binary())})


def build_index(counts: DataFrame) -> tuple[DataFrame, int]:
    """One row (shard, n, data) for each shard of the distinct line hashes, n being the sum of their counts; the number of shards."""
    counts = settle(counts, "line-counts")
    shards = max(1, -(-counts.count() // SHARD_KEYS))
    keyed = counts.withColumn("shard", F.pmod(F.col("a"), F.lit(shards)).cast("int"))
    return settle(keyed.groupBy("shard").applyInArrow(_build, "shard int, n long, data binary"), "line-index"), shards


def _probes(shards: int):
    """A row for each different line of a text: its hash, the shard that knows it, and its places in the text."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        seen: set[bytes] = set()  # copies in one task are asked about once, so no text's lines are asked about by every row
        for batch in few(batches):
            names = batch.column("t").to_pylist()
            fresh = [i for i, t in enumerate(names) if t not in seen and not seen.add(t)]
            if len(seen) >= HELD:
                seen.clear()
            batch = batch.take(pa.array(fresh, pa.int64()))
            found = [_keys(t.split(b"\n")) for t in raw(batch.column("text"))]
            a, b = _halves([k for x in found for k in x])
            at = np.repeat(np.arange(len(found)), [len(x) for x in found])
            places = pa.array([p for x in found for p in x.values()], pa.list_(pa.int32()))
            yield pa.record_batch({"t": batch.column("t").take(pa.array(at)), "shard": pa.array((a % shards).astype(np.int32)), "a": pa.array(a), "b": pa.array(b), "at": places})

    return run


def _answer(min_docs: int):
    """Probes of lines that are in at least so many documents; a shard's own row comes before its probes."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from cladeworks.llm.perfect_hash import Shard

        shard = None
        for b in few(batches, ANSWERS):
            heads = np.flatnonzero(b.column("data").is_valid().to_numpy(zero_copy_only=False)).tolist()
            for start, end in zip([0, *(h + 1 for h in heads)], [*heads, b.num_rows], strict=True):
                if end > start:
                    rows = b.slice(start, end - start)
                    x, y = (np.ascontiguousarray(rows.column(c).to_numpy(zero_copy_only=False)).astype(np.int64).view(np.uint64) for c in "ab")
                    often = np.flatnonzero(shard.count(x, y) >= min_docs)
                    yield rows.take(pa.array(often)).select(["t", "at"])
                if end < b.num_rows:
                    shard = Shard.load(b.column("data")[end].as_py())

    return run


def common_lines(docs: DataFrame, min_docs: int) -> DataFrame:
    """t (MD5 of a text), marks (array<int>): the places of the lines common to ``min_docs`` rows, of each text that has some.

    Probes are dealt by shard, and those of a shard with many to several tasks with a copy of the shard each. The
    index never leaves the executors, and no task holds more than one shard.
    """
    index, shards = build_index(line_counts(docs))
    index = index.withColumn("copies", F.ceil(F.col("n") / PROBES).cast("int"))
    hot = index.where("copies > 1").select("shard", "copies")  # at most a row for PROBES probes
    probes = texts(docs, F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("t")).select("t", "text").mapInArrow(_probes(shards), "t binary, shard int, a long, b long, at array<int>")
    probes = probes.join(F.broadcast(hot), "shard", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("t"), F.col("copies")), F.lit(0)).cast("int")).drop("copies")
    heads = index.select("shard", "data", F.explode(F.sequence(F.lit(0), F.greatest(F.col("copies"), F.lit(1)) - 1)).alias("part"))
    both = probes.withColumn("data", F.lit(None).cast("binary")).unionByName(heads, allowMissingColumns=True)
    dealt = both.repartition("shard", "part").sortWithinPartitions("shard", "part", F.col("data").isNull())
    found = dealt.select("t", "a", "b", "at", "data").mapInArrow(_answer(min_docs), "t binary, at array<int>")
    return settle(found.dropDuplicates().groupBy("t").agg(F.array_sort(F.flatten(F.collect_list("at"))).alias("marks")), "line-marks")


def _drop(batches):
    import pyarrow as pa

    for b in few(batches):
        lines = [t.split(b"\n") for t in raw(b.column("text"))]
        marks = [set(m or ()) for m in b.column("marks").to_pylist()]
        kept = [b"\n".join(x for i, x in enumerate(doc) if i not in m) if m else b"\n".join(doc) for doc, m in zip(lines, marks, strict=True)]
        rest = {c: b.column(c) for c in b.schema.names if c not in ("text", "marks")}
        yield pa.record_batch(rest | {"n_lines": pa.array(list(map(len, lines)), pa.int64()), "n_dropped": pa.array(list(map(len, marks)), pa.int64()), "kept": pa.array(kept, pa.binary()).cast(pa.string())})


def drop_common_lines(docs: DataFrame, *more: str, min_docs: int = 10) -> DataFrame:
    """doc_id, the columns named in ``more``, n_lines, n_dropped, kept: each text without lines common to ``min_docs`` documents.

    A text is split at \\n (null or empty: one empty line). Lines are compared without white space at the ends and
    without regard to the case of A-Z; empty ones always stay. Each row counts as a document, so repeated rows count
    each time; a line counts once for a row. An empty table gives an empty result; columns that are not named are left
    behind. A line is known by a 128-bit hash: 64 bits lead to the slot of the perfect hash, whose fingerprint holds
    the other 64. However large the index, texts are read three times and never written.
    """
    marks = common_lines(docs, min_docs)
    size, total = marks.agg(F.count("*"), F.coalesce(F.sum(F.size("marks")), F.lit(0))).first()
    if size <= MOST_TEXTS and total <= MOST_MARKS:
        marks = F.broadcast(marks)
    rows = texts(docs, *more)
    kinds = dict(rows.dtypes)
    rest = ", ".join(f"`{c}` {kinds[c]}" for c in rows.columns if c != "text")
    rows = rows.withColumn("t", F.unhex(F.md5("text"))).join(marks, "t", "left").select(*rows.columns, "marks")
    return rows.mapInArrow(_drop, f"{rest}, n_lines long, n_dropped long, kept string")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that at least ten of them have; cases as in ``drop_common_lines``."""
    out = drop_common_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d),
k AS (SELECT doc_id, line, i, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT k.doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
  sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.i) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key GROUP BY k.doc_id
"""

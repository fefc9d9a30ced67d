"""SimHash document fingerprints of 256 bits, and their near neighbours by permuted block tables."""

from __future__ import annotations

import functools
import itertools
import math
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeworks.llm.common import few, in_groups, raw, table, texts
from cladeworks.session import settle

#: A term is this many words in a row; a fingerprint has this many bits. With single words, texts that share eight in
#: ten of their runs of five words differ in 7 to 19 bits (the tenth and ninetieth percentile), with three in 20 to 32.
TERM_WORDS, BITS = 1, 256
#: Fingerprints are near if at most so many bits differ.
RADIUS = 20
#: Up to so many fingerprints, a table is keyed by one of RADIUS + 1 blocks; with more, by two of RADIUS + 2, which
#: makes more tables of much smaller groups. Either way finds all near ones.
ONE_BLOCK = 50_000_000
#: Words whose hash a worker keeps.
KEPT_WORDS = 300_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh64_intdigest(word)
        if len(self) < KEPT_WORDS:
            self[word] = h
        return h


@functools.cache
def _hashes() -> _Hashes:
    return _Hashes()


def _mix(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(text: str) -> bytes:
    """32 bytes: bit i is set if the terms' signed votes for it, weighted by 1 + log2(count), sum to more than 0.

    Terms are runs of TERM_WORDS words in lower case (fewer words: all of them); no word: all bits 0.
    """
    import numpy as np

    words = text.lower().encode("utf-8", "replace").split()
    if not words:
        return bytes(BITS // 8)
    with np.errstate(over="ignore"):
        h = np.fromiter(map(_hashes().__getitem__, words), np.uint64, len(words))
        n = min(TERM_WORDS, len(h))
        term = np.zeros(len(h) - n + 1, np.uint64)
        for i in range(n):
            term = _mix(term + h[i : len(h) - n + 1 + i] + np.uint64(0x9E3779B97F4A7C15))
        term, count = np.unique(term, return_counts=True)
        weight, votes = (1 + np.log2(count)).astype(np.float32), np.zeros(BITS)
        for i in range(0, len(term), 4096):
            t = term[i : i + 4096]
            wide = np.stack([_mix(t ^ np.uint64(s * 0xD1342543DE82EF95 & (2**64 - 1))) for s in range(BITS // 64)], 1)
            bits = np.unpackbits(wide.view(np.uint8), axis=1)
            votes += weight[i : i + 4096] @ bits.astype(np.float32)
    return np.packbits(2 * votes > weight.sum(dtype=np.float64)).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """The cosine of term weights that the share of differing bits stands for: 1 if none differs, 0 from a half on."""
    differ = (int.from_bytes(a) ^ int.from_bytes(b)).bit_count()
    return max(0.0, math.cos(math.pi * differ / BITS))


def edited(text: str, other: str) -> str:
    """The text with its last third (rounded down) replaced by as much of the beginning of the other."""
    third = len(text) // 3
    return text[: len(text) - third] + other[:third]


def _packed(batches):
    """Fingerprints, and the texts compressed, as they are shuffled."""
    import pyarrow as pa
    import zstandard

    pack = zstandard.ZstdCompressor(level=1).compress
    for b in few(batches):
        found = raw(b.column("text"))
        rest = {c: b.column(c) for c in b.schema.names if c != "text"}
        yield pa.record_batch(rest | {"fp": pa.array([fingerprint(t.decode()) for t in found], pa.binary()), "z": pa.array(list(map(pack, found)), pa.binary())})


def _pairs(batches):
    """Digests of each row and the one after it in its bucket; the row marked as carried only stands at the end."""
    import hashlib

    import pyarrow as pa
    import zstandard

    names = ("doc_id", "n_chars", "edited_sha256", "fp", "edited_fp", "near_edited", "near_next")
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64())
    unpack = zstandard.ZstdDecompressor().decompress
    last = None
    for b in few(batches):
        rows = []
        for bucket, sub, carried, doc, fp, z in zip(*(b.column(c).to_pylist() for c in ("bucket", "sub", "carried", "doc_id", "fp", "z")), strict=True):
            text = unpack(z).decode()
            if last and last[0] == (bucket, sub) and not last[1]:
                _, _, own, whole, mine = last
                new = edited(whole, text)
                other = fingerprint(new)
                rows.append((own, len(whole), hashlib.sha256(new.encode()).hexdigest(), mine, other, likeness(mine, other), likeness(mine, fp)))
            last = ((bucket, sub), carried, doc, text, fp)
        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * len(names), kinds, strict=True)], names=list(names))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fp, edited_fp, near_edited, near_next of every row.

    The next document is the one after it by descending doc_id (null: last; repeated doc_ids: in a fixed order of
    texts); after the last comes the first. Null texts are empty; texts of any length are whole; an empty table gives
    no rows; other columns are left behind. Rows are dealt to buckets between quantiles of doc_id; each bucket also
    gets the first document of the next one, so each text is shuffled once. A doc_id (or null) that fills several
    buckets is dealt to as many by the hash of the text.
    """
    from pyspark.ml.feature import Bucketizer

    spark = docs.sparkSession
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = texts(docs).withColumn("order", F.coalesce("doc_id", F.lit(-(2**63))))
    cuts = rows.agg(F.percentile_approx("order", [i / n for i in range(1, n)], 20 * n)).first()[0] or []
    often = {v: m for v, m in Counter(cuts).items() if m > 1}
    splits = [-math.inf, *sorted({float(x) for x in cuts}), math.inf]
    if len(splits) == 2:
        splits.insert(1, 0.0)
    place = Bucketizer(splits=splits, inputCol="at", outputCol="bucket")
    rows = place.transform(rows.withColumn("at", F.col("order").cast("double"))).withColumn("bucket", F.col("bucket").cast("int")).drop("at")
    if often:  # their rows are ordered by hash, in as many parts
        rows = rows.join(F.broadcast(spark.createDataFrame(list(often.items()), "order long, parts int")), "order", "left")
        rows = rows.withColumn("hash", F.when(F.col("parts").isNotNull(), F.xxhash64("text")).otherwise(F.lit(0)))
        rows = rows.withColumn("sub", F.when(F.col("parts").isNull(), -1).otherwise(F.floor((F.col("hash") / 2.0**64 + 0.5) * F.col("parts"))).cast("int")).drop("parts")
    else:
        rows = rows.withColumn("hash", F.lit(0).cast("long")).withColumn("sub", F.lit(-1))
    first = F.max(F.struct("order", F.bitwise_not("hash").alias("inverse")))
    heads = [((-r.bucket, r.sub), (r.x.order, ~r.x.inverse)) for r in rows.groupBy("bucket", "sub").agg(first.alias("x")).collect()]  # at most 2 n rows
    heads.sort()
    before = [(*head, -heads[i - 1][0][0], heads[i - 1][0][1]) for i, (_, head) in enumerate(heads)]
    ahead = spark.createDataFrame(before, "order long, hash long, bucket int, sub int").groupBy("order", "hash").agg(F.collect_list(F.struct("bucket", "sub", F.lit(True).alias("carried"))).alias("ahead"))
    packed = rows.select("doc_id", "order", "hash", "bucket", "sub", "text").mapInArrow(_packed, "doc_id long, order long, hash long, bucket int, sub int, fp binary, z binary")
    packed = packed.join(F.broadcast(ahead), ["order", "hash"], "left")
    own = F.array(F.struct("bucket", "sub", F.lit(False).alias("carried")))
    copies = packed.select(F.explode(F.concat(own, F.coalesce("ahead", F.array().cast("array<struct<bucket:int,sub:int,carried:boolean>>")))).alias("d"), "order", "hash", "doc_id", "fp", "z").select("d.*", "order", "hash", "doc_id", "fp", "z")
    ordered = copies.repartition(n // 4, "bucket", "sub").sortWithinPartitions(F.desc("bucket"), "sub", "carried", F.desc("order"), "hash", "z")
    schema = "doc_id long, n_chars long, edited_sha256 string, fp binary, edited_fp binary, near_edited double, near_next double"
    return ordered.select("bucket", "sub", "carried", "doc_id", "fp", "z").mapInArrow(_pairs, schema)


def _cuts(same: int) -> list[int]:
    m = RADIUS + same
    return [BITS * i // m for i in range(m + 1)]


def _tables(same: int):
    """Rows (key, fp): for each choice of ``same`` blocks, the number of the choice with the bits of these blocks."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        cuts = _cuts(same)
        for b in few(batches):
            bits = np.unpackbits(np.frombuffer(b"".join(b.column("fp").to_pylist()), np.uint8).reshape(-1, BITS // 8), axis=1).astype(np.int64)
            blocks = [bits[:, x:y] @ (1 << np.arange(y - x)) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
            for number, chosen in enumerate(itertools.combinations(range(len(blocks)), same)):
                key = np.zeros(len(bits), np.int64)
                for i in chosen:
                    key = key << (cuts[i + 1] - cuts[i]) | blocks[i]
                yield pa.record_batch({"key": pa.array(number << 32 | key), "fp": b.column("fp")})

    return run


def _near(same: int):
    """How many rows of the same group each fingerprint is near to, counted in the first table in which the two meet."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        cuts = _cuts(same)
        choices = list(itertools.combinations(range(len(cuts) - 1), same))
        def out(rows):
            fp = np.frombuffer(b"".join(r[4] for r in rows), "<u8").reshape(-1, BITS // 64)
            part, n = np.array([r[2] for r in rows]), np.zeros(len(rows), np.int64)
            blocks = choices[rows[0][1] >> 32]
            for i in range(0, len(rows), 256):
                x = np.arange(i, min(i + 256, len(rows)))
                r, c = np.nonzero(np.bitwise_count(fp[x, None, 0] ^ fp[None, i:, 0]) <= RADIUS)  # few pass in one word
                r, c = r + i, c + i
                ok = r < c
                if rows[0][3]:
                    ok &= part[r] != part[c]
                r, c = r[ok], c[ok]
                apart = fp[r] ^ fp[c]
                ok = np.bitwise_count(apart).sum(1) <= RADIUS
                r, c, apart = r[ok], c[ok], apart[ok]
                if len(r):
                    bits = np.unpackbits(np.ascontiguousarray(apart).view(np.uint8), axis=1)
                    equal = np.stack([~bits[:, a:z].any(1) for a, z in zip(cuts[:-1], cuts[1:], strict=True)], 1)
                    first = equal[:, : blocks[-1] + 1].sum(1) == same  # else they meet in an earlier table
                    n += np.bincount(r[first], minlength=len(n)) + np.bincount(c[first], minlength=len(n))
            found = np.flatnonzero(n)
            return pa.record_batch({"fp": pa.array([rows[k][4] for k in found], pa.binary()), "n": pa.array(n[found])})

        rows: list[tuple] = []
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("g", "key", "part", "split", "fp")), strict=True):
                if rows and rows[-1][:2] != row[:2]:
                    if len(rows) > 1:
                        yield out(rows)
                    rows = []
                rows.append(row)
        if len(rows) > 1:
            yield out(rows)

    return run


def near_counts(fingerprints: DataFrame, same: int | None = None) -> DataFrame:
    """fp, n_near for each distinct fp (32 bytes; nulls are passed over) with other distinct ones within the radius.

    If at most RADIUS bits differ, ``same`` of RADIUS + ``same`` blocks are equal, so the two meet in the table of one
    choice of so many blocks. ``same`` follows the number of fingerprints unless it is given. A group of many rows is
    dealt to parts, and each two parts are compared in a task of their own. An empty table gives none.
    """
    rows = settle(fingerprints.where("fp is not null").select("fp").distinct(), "distinct")
    if same is None:
        same = 1 if rows.count() <= ONE_BLOCK else 2
    dealt = in_groups(rows.mapInArrow(_tables(same), "key long, fp binary"), "fp").select("g", "key", "part", "split", "fp")
    return dealt.mapInArrow(_near(same), "fp binary, n long").groupBy("fp").agg(F.sum("n").alias("n_near"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and how many other fingerprints are near; cases as in ``with_next`` and ``near_counts``."""
    rows = settle(with_next(table(spark, sf_dir, "documents")), "fingerprints")
    near = settle(near_counts(rows), "near")
    text = lambda c: F.lower(F.hex(c)).alias(c.replace("fp", "fingerprint"))
    return rows.join(near, "fp", "left").select("doc_id", "n_chars", "edited_sha256", text("fp"), text("edited_fp"), "near_edited", "near_next", F.coalesce("n_near", F.lit(0)).alias("n_near"))

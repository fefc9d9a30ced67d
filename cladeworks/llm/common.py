"""What the operators share: table access and small text rules."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeworks.session import settle

#: The white space of the contracts: a space and the code points 9 to 13.
SPACE = b" \t\n\x0b\x0c\r"
#: Rows that a function over Arrow batches works on at a time; Spark bounds the bytes of its batches.
ROWS = 1000
#: Most rows of a group that are compared with each other in one task.
GROUP_ROWS = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *more: str | Column) -> DataFrame:
    """doc_id, text (null: empty) and the columns named; any others are left behind, so their names can't clash.

    A session that still has Spark's default of 10,000 rows in an Arrow batch gets ROWS: texts may be long, and each
    task holds a batch on either side. Another setting stays.
    """
    conf, name = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(name, "10000") == "10000":
        conf.set(name, str(ROWS))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def few(batches, rows: int = ROWS) -> Iterator:
    """The batches in slices of so many rows, so that what is made of them stays small; freed memory goes back at once."""
    import pyarrow as pa

    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)
        del b
        pa.default_memory_pool().release_unused()


def each(blocks: list) -> Iterator:
    """The values of broadcasts, one after the other; if there are several, a task holds only one at a time."""
    for b in blocks:
        yield b.value
        if len(blocks) > 1:
            vars(b).pop("_value", None)


def raw(column) -> list[bytes]:
    """The UTF-8 of an Arrow string column."""
    import pyarrow as pa

    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def digests(values: list[bytes]):
    """The 128-bit hashes of byte strings, as two arrays of 64 bits."""
    import numpy as np
    import xxhash

    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, values)), "<u8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def small(df: DataFrame, most: int, name: str = "small") -> DataFrame:
    """The table, written out, and to be broadcast if it has at most that many rows."""
    df = settle(df, name)
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def in_groups(rows: DataFrame, item: str, most: int = GROUP_ROWS) -> DataFrame:
    """``rows`` (key and others) dealt and sorted by group: key, then g, part, split and the other columns.

    Rows of one key meet in one group. A key with more than ``most`` rows is dealt to parts by the hash of ``item``,
    and each two parts meet in a group of their own, where ``split`` tells that only rows of different parts are new
    to each other; the groups of one part are those where part meets itself (split false). ``rows`` are made twice.
    """
    counts = rows.groupBy("key").count().where(F.col("count") > most)
    hot = settle(counts.select("key", F.ceil(F.col("count") / most).cast("int").alias("parts")), "hot-keys")
    if hot.isEmpty():
        dealt = rows.withColumn("g", F.col("key").cast("long")).withColumn("part", F.lit(0)).withColumn("split", F.lit(False))
    else:
        dealt = rows.join(hot, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.pmod(F.xxhash64(item), F.col("parts")).cast("int"))
        dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        pair = F.when(F.col("parts") == 1, F.col("key").cast("long")).otherwise(F.xxhash64("key", F.least("part", "with"), F.greatest("part", "with")))
        dealt = dealt.withColumn("g", pair).withColumn("split", F.col("part") != F.col("with")).drop("parts", "with")
    return dealt.repartition("g").sortWithinPartitions("g", "key", "part", item)

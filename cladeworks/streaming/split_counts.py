"""Split frequencies of a stream of tree files, held by split in Spark's state store.

Of all stages, only the counts of splits are sums over trees, so only these can be kept incrementally.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cladeworks.functions import bits
from cladeworks.operators.splits import MOST_TAXA
from cladeworks.session import remove
from cladeworks.sources import newick


def _splits(words, n: int):
    """a, b of the nodes of trees whose leaves are all in the dictionary; one run of XOR along the leaves of a batch."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            sides = {"left": [], "right": []}
            for labels, start, mid, end in zip(*(batch.column(c).to_pylist() for c in ("labels", "start", "mid", "end")), strict=True):
                own = [words.value.get(x) for x in labels]
                if None in own or not start:
                    continue
                upto = np.bitwise_xor.accumulate(np.array([(0,) * len(own[0]), *own], np.int64))
                s, m, e = (np.array(x) for x in (start, mid, end))
                for side, x, y in (("left", s, m), ("right", m, e)):
                    sides[side].append(np.concatenate([upto[x] ^ upto[y], *[(y - x)[:, None]] * (n == bits.HASHED)], axis=1))
            width = n or 3
            columns = []
            for rows in sides.values():
                every = np.concatenate(rows) if rows else np.zeros((0, width), np.int64)
                columns.append(pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(every[:, i])) for i in range(width)], names=[f"w{i}" for i in range(width)]))
            yield pa.record_batch(columns, names=list(sides))

    return run


def counts(lines: DataFrame, taxa: DataFrame, n: int) -> DataFrame:
    """a, b, freq of the splits of a stream of lines (value); taxa (taxon, label) is the dictionary, n the words of a set, or HASHED.

    Trees with another label are left out, like lines that are no trees. Each line is parsed where it is read; of a batch
    one row for each of its splits is added to the state.
    """
    spark = lines.sparkSession
    known = taxa.select("label", *(w.alias(f"w{i}") for i, w in enumerate(bits.singleton(F.col("taxon"), n)[: n or 2]))).limit(MOST_TAXA + 1).collect()
    if len(known) > MOST_TAXA:
        raise ValueError(f"the dictionary is sent to all tasks; {MOST_TAXA} labels are the most")
    words = spark.sparkContext.broadcast({r[0]: tuple(r[1:]) for r in known})
    trees = newick.shaped(lines.select(F.lit(0).cast("long").alias("tree_id"), F.col("value").alias("newick")))
    trees = trees.where(newick.status_of("ignore", F.lit(False)) == "ok").select("labels", "start", "mid", "end")
    nodes = trees.mapInArrow(_splits(words, n), f"left {bits.kind(n)}, right {bits.kind(n)}")
    return nodes.groupBy(F.least("left", "right").alias("a"), F.greatest("left", "right").alias("b")).agg(F.count("*").alias("freq"))


def start(spark: SparkSession, folder: str, out: str, checkpoint: str, taxa: DataFrame, n_taxa: int) -> StreamingQuery:
    """Count the splits of each new text file of trees in ``folder``.

    The totals of the splits that a batch has go to ``out``/batch=N: they replace earlier ones, so that a batch that is run
    again writes the same rows to the same place. Totals are kept with the ``checkpoint``, from which a new start goes on.
    """
    lines = spark.readStream.schema("value string").text(folder)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    found = counts(lines, taxa, bits.words(n_taxa)).writeStream.outputMode("update").foreachBatch(write)
    return found.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def totals(spark: SparkSession, out: str) -> DataFrame:
    """a, b, freq: of each split the last total."""
    return spark.read.parquet(out).groupBy("a", "b").agg(F.max_by("freq", "batch").alias("freq"))


def compact(spark: SparkSession, out: str) -> None:
    """Merge all batches so far into the last one, and remove the others. Call it between runs of the stream.

    The merged rows are written beside the batches first. A compaction that broke off after that is ended by the next
    one; one that broke off before has changed nothing.
    """
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(out)
    files = path.getFileSystem(hadoop)
    names = sorted(x.getPath().getName() for x in files.listStatus(path))
    batches = sorted(int(x.partition("=")[2]) for x in names if x.startswith("batch="))
    for name in [x for x in names if x.startswith("_merged-")]:
        if files.exists(jvm.org.apache.hadoop.fs.Path(f"{out}/{name}/_SUCCESS")):
            _replace(spark, out, int(name.partition("-")[2]), batches)
        else:
            remove(spark, f"{out}/{name}")
    if len(batches) > 1:
        totals(spark, out).repartition("a").write.parquet(f"{out}/_merged-{batches[-1]}")
        _replace(spark, out, batches[-1], batches)


def _replace(spark: SparkSession, out: str, last: int, batches: list[int]) -> None:
    spark.read.parquet(f"{out}/_merged-{last}").write.mode("overwrite").parquet(f"{out}/batch={last}")
    remove(spark, *(f"{out}/batch={b}" for b in batches if b < last), f"{out}/_merged-{last}")

"""Token ids in Parquet list columns: sorted by document, dictionary-encoded ids, delta-encoded numbers, page indexes."""

from __future__ import annotations

import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cladeworks.llm import tokens
from cladeworks.llm.common import few, table, texts
from cladeworks.session import settle, work_dir

#: Bytes of a row group, rows and bytes of a page: a page is what a selective read fetches.
ROW_GROUP, PAGE_ROWS, PAGE_BYTES = 32 << 20, 2_000, 256 << 10
#: Most files whose offsets (12 bytes each) are broadcast; beyond, they are joined.
MOST_PARTS = 1_000_000


def _encode(path: str):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        from cladeworks.llm.common import raw

        part, before = TaskContext.get().partitionId(), 0
        for b in few(batches):
            ids = [tokens.encode(t, path) for t in raw(b.column("text"))]
            ends = np.cumsum([0, *(len(x) // 4 for x in ids)])
            yield pa.record_batch(
                {
                    "doc_id": b.column("doc_id"),
                    "part": pa.array(np.full(len(ids), part, np.int32)),
                    "start_in_part": pa.array(before + ends[:-1]),
                    "n_tokens": pa.array(np.diff(ends)),
                    "ids": pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(ids), "<i4"))),
                }
            )
            before += int(ends[-1])

    return run


def write(docs: DataFrame, path: str, tokenizer: str) -> None:
    """Encode whole texts and write them under ``path``, ascending by doc_id over the files and within each.

    A null text is empty (the end id alone); null doc_ids come first, rows with one doc_id are ordered by text and
    written each; texts of any length are one row; an empty table gives files without rows; other columns are left behind.
    Ids are dictionary-encoded, or delta-encoded in pages where a dictionary does not pay; the other columns are
    delta-encoded. Row groups and pages have fixed bounds, and each file has column and offset indexes.
    """
    ordered = texts(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    encoded = ordered.mapInArrow(_encode(tokenizer), "doc_id long, part int, start_in_part long, n_tokens long, ids array<int>")
    options = {"compression": "zstd", "parquet.writer.version": "v2", "parquet.block.size": ROW_GROUP, "parquet.page.size": PAGE_BYTES, "parquet.page.row.count.limit": PAGE_ROWS, "parquet.enable.dictionary": "true"}
    options |= {f"parquet.enable.dictionary#{c}": "false" for c in ("doc_id", "part", "start_in_part", "n_tokens")}
    encoded.write.options(**options).parquet(path)


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and, on demand, ids.

    Without ids only the small columns are read; a filter on doc_id reaches the page indexes.
    """
    stored = spark.read.schema("doc_id long, part int, start_in_part long, n_tokens long, ids array<int>").parquet(path)
    before = F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = settle(stored.groupBy("part").agg(F.sum("n_tokens").alias("tokens")).select("part", F.coalesce(before, F.lit(0)).alias("before")), "parts")
    if parts.count() <= MOST_PARTS:
        parts = F.broadcast(parts)
    return stored.join(parts, "part").select("doc_id", (F.col("before") + F.col("start_in_part")).alias("start"), "n_tokens", *["ids"] * with_ids)


def _checksums(batches):
    import numpy as np
    import pyarrow as pa

    for b in few(batches):
        lists = b.column("ids")
        ends, values = lists.offsets.to_numpy(), memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<u4")).cast("B")
        crc = [zlib.crc32(values[4 * x : 4 * y]) for x, y in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.record_batch({"doc_id": b.column("doc_id"), "start": b.column("start"), "n_tokens": pa.array(np.diff(ends).astype(np.int64)), "ids_crc32": pa.array(crc, pa.int64())})


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents' ids, read the files back, and digest what they hold."""
    path = f"{work_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "documents"), path, tokens.default_path())
    return read(spark, path).mapInArrow(_checksums, "doc_id long, start long, n_tokens long, ids_crc32 long")

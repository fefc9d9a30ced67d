"""Rows in blocks of bounded size: all of one table against all of another, each task with one block of either; or a task's batches in parts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def against(one: DataFrame, other: DataFrame, run: Callable, schema: str, sizes: tuple[int, int]) -> DataFrame:
    """``run(one_block, other_block) -> pyarrow table`` for each two blocks of about so many rows of ``one`` and ``other``.

    Rows are dealt to blocks by their hash; a block is sent once for each block of the other side.
    """
    n = [max(1, -(-df.count() // size)) for df, size in zip((one, other), sizes, strict=True)]
    deal = lambda df, k: F.pmod(F.xxhash64(*df.columns), F.lit(n[k])).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(n[k] - 1)))
    other = other.select(*(F.col(c).alias(c) for c in other.columns))  # new columns, should both be one table
    x = one.withColumn("block_x", deal(one, 0)).withColumn("block_y", every(1))
    y = other.withColumn("block_y", deal(other, 1)).withColumn("block_x", every(0))
    return x.groupBy("block_x", "block_y").cogroup(y.groupBy("block_x", "block_y")).applyInArrow(run, schema)


def limited(batches, column: str, most: int):
    """The batches in parts whose lists or texts in ``column`` have about ``most`` elements or bytes together, or one row."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    for b in batches:
        values = b.column(column)
        sizes = (pc.list_value_length if hasattr(values.type, "value_type") else pc.binary_length)(values)
        upto = np.cumsum(sizes.fill_null(0).to_numpy(zero_copy_only=False))
        i = 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + most, "right")))
            yield b if j - i == b.num_rows else b.take(pa.array(np.arange(i, j)))
            i = j

"""Sets of taxa as structs of 64-bit words, and the columns that set algebra makes of them.

A set is known by its members, 63 taxa a word, or, for many taxa, by two 64-bit hashes (the XOR of its members') and its
size, whatever the number of taxa. Where functions take the number of words, HASHED stands for the latter. Of hashed
sets there are only unions of disjoint ones and differences from one that holds the other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TAXA_A_WORD = 63
#: In place of the number of words: sets are known by hashes.
HASHED = 0


def words(n_taxa: int) -> int:
    return max(1, -(-n_taxa // TAXA_A_WORD))


def key(columns: list[Column]) -> Column:
    return F.struct(*(c.alias(f"w{i}") for i, c in enumerate(columns)))


def parts(mask: Column | str, n: int) -> list[Column]:
    mask = F.col(mask) if isinstance(mask, str) else mask
    return [mask[f"w{i}"] for i in range(n)]


def singleton(taxon: Column, n: int) -> list[Column]:
    """Words of the set that holds one taxon."""
    if n == HASHED:
        return [F.xxhash64(taxon.cast("long")), F.xxhash64(F.lit("second"), taxon.cast("long")), F.lit(1).cast("long")]
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (taxon % TAXA_A_WORD).cast("int"))
    return [F.when(F.floor(taxon / TAXA_A_WORD) == i, bit).otherwise(F.lit(0).cast("long")) for i in range(n)]


def _hashed(a, b, sign: int) -> Column:
    (p, q, k), (x, y, m) = parts(a, 3), parts(b, 3)
    return key([p.bitwiseXOR(x), q.bitwiseXOR(y), k + sign * m])


def union(a, b, n: int) -> Column:
    if n == HASHED:
        return _hashed(a, b, 1)
    return key([x.bitwiseOR(y) for x, y in zip(parts(a, n), parts(b, n), strict=True)])


def minus(a, b, n: int) -> Column:
    if n == HASHED:
        return _hashed(a, b, -1)
    return key([x.bitwiseAND(F.bitwise_not(y)) for x, y in zip(parts(a, n), parts(b, n), strict=True)])


def size(a, n: int) -> Column:
    if n == HASHED:
        return parts(a, 3)[2]
    return reduce(Column.__add__, (F.bit_count(x).cast("long") for x in parts(a, n)))


def kind(n: int) -> str:
    """The type of a set."""
    return "struct<" + ",".join(f"w{i}:bigint" for i in range(n or 3)) + ">"


def overlap(a, b, n: int) -> Column:
    return reduce(Column.__add__, (F.bit_count(x.bitwiseAND(y)).cast("long") for x, y in zip(parts(a, n), parts(b, n), strict=True)))


def contains(a, b, n: int) -> Column:
    """Whether all of b is in a."""
    return reduce(Column.__and__, (x.bitwiseAND(y) == y for x, y in zip(parts(a, n), parts(b, n), strict=True)))

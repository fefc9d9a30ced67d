"""What the operators on conversations share: rows of (conv_id, turn, role, text) in a defined order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word of the contracts: no space, no code point from 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def turns(conversations: DataFrame, null: str) -> DataFrame:
    """conv_id, turn, role, text; a null role or text is ``null``. Other columns are left behind, so their names can't clash."""
    long = lambda c: F.col(c).cast("long").alias(c)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(null)).alias(c)
    return conversations.select(long("conv_id"), long("turn"), text("role"), text("text"))


def digest(role: Column | str = "role", text: Column | str = "text") -> Column:
    """128 bits, in hex, that stand for a role and a text."""
    role = F.col(role) if isinstance(role, str) else role
    return F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))


#: In DuckDB's SQL: the unsigned crc32 of an ASCII text, the words of a text, and the hash of a role and a text.
CRC_SQL = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split({0}, ''), lambda x: CAST(ascii(x) AS BIGINT))),
  lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, i: xor(c >> 1, (c & 1) * 3988292384))), 4294967295)"""
WORDS_SQL = "len(regexp_extract_all({0}, '[^\\x20\\x09-\\x0D]+'))"
DIGEST_SQL = "md5(CAST(length(role) AS VARCHAR) || ':' || role || text)"

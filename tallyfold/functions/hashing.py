"""Hash expressions that other SQL engines can repeat."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_key(*cols: Column) -> Column:
    """One key for the content of several columns; nulls get a mark of their own."""
    parts = [F.coalesce(c.cast("string"), F.lit("\x00")) for c in cols]
    return F.md5(F.concat_ws("\x1f", *parts))


def hash_mod(group: Column, k: int, seed: str = "", portable: bool = True) -> Column:
    """Hash of seed + group modulo k. Null groups share one value.

    Portable: the first 32 bits of md5, which other engines can repeat. Else Spark's
    own hash, which takes about a tenth of the time.
    """
    text = F.concat(F.lit(seed), F.coalesce(group.cast("string"), F.lit("")))
    if not portable:
        return F.pmod(F.xxhash64(text), F.lit(k)).cast("int")
    bits = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
    return (bits % k).cast("int")

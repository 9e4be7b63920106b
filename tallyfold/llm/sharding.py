"""Weighted rendezvous sharding of record keys.

Each shard draws a number for a key from md5(key, shard); the shard with the least -ln(u) / w
takes the record. Another shard only takes records into itself, and a shard's share of the
keys is its weight's.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARDS = 8
BUCKET_DIGITS = 3
HEX_DIGITS = 13


def draw(key: Column, shard: int) -> Column:
    """Uniform in (0, 1), from 52 bits of md5(shard:key)."""
    digest = F.md5(F.concat(F.lit(f"{shard}:"), F.coalesce(key.cast("string"), F.lit(""))))
    bits = F.conv(F.substring(digest, 1, HEX_DIGITS), 16, 10).cast("double")
    return (bits + 0.5) / F.lit(float(1 << (4 * HEX_DIGITS)))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Number of the shard that takes the key; ties go to the lower number. A null key is
    a key of its own. Shards of weight 0 take nothing."""
    if not any(w > 0 for w in weights):
        raise ValueError("no shard has a positive weight")
    costs = [
        F.struct((-F.log(draw(key, s)) / F.lit(float(w))).alias("cost"), F.lit(s).alias("shard"))
        for s, w in enumerate(weights)
        if w > 0
    ]
    return (F.least(*costs) if len(costs) > 1 else costs[0])["shard"]


def numbered(rows: DataFrame, shard: str, key: str, ties: Sequence[str]) -> DataFrame:
    """Add ``slot``: 0, 1, 2, ... in each shard by (md5 of key and ties, key, ties).

    Records are ranked inside buckets of a shard, the first digits of the md5; the number of
    records in the buckets before is added. No task holds a shard; a bucket's share of the
    records that differ is 1 in 4,096, also of those of one key. The table of bucket sizes has
    4,096 rows a shard, whatever the input.
    """
    told = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (key, *ties)])
    cut = rows.withColumn("_order", F.md5(told)).withColumn(
        "_bucket", F.substring("_order", 1, BUCKET_DIGITS)
    )
    sizes = cut.groupBy(shard, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = F.expr(
        f"sum(_n) over (partition by `{shard}` order by _bucket rows between unbounded preceding and 1 preceding)"
    )
    offsets = sizes.select(shard, "_bucket", F.coalesce(before, F.lit(0)).alias("_before"))
    order = ", ".join(f"`{c}`" for c in ("_order", *ties))
    rank = F.expr(f"row_number() over (partition by `{shard}`, _bucket order by {order})")
    return (
        cut.join(F.broadcast(offsets), [shard, "_bucket"])
        .withColumn("slot", F.col("_before") + rank - 1)
        .drop("_before", "_order", "_bucket")
    )


def assign(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    weights: Sequence[float] = (1.0,) * SHARDS,
    new_weight: float = 1.0,
) -> DataFrame:
    """key, size, text_crc32, law, shard, slot, grown_shard for every row.

    ``size``: the text's UTF-8 bytes plus 1; ``text_crc32``: null texts count as empty.
    ``grown_shard``: the shard if one of ``new_weight`` were added. Rows with the same key,
    null or not, share a shard and have slots of their own.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key),
        (F.octet_length(body) + 1).cast("bigint").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(F.col(key), weights).alias("shard"),
        rendezvous(F.col(key), (*weights, new_weight)).alias("grown_shard"),
    )
    return numbered(rows, "shard", key, (key, "size", "text_crc32")).select(
        key, "size", "text_crc32", "law", "shard", F.col("slot").cast("bigint").alias("slot"), "grown_shard"
    )


def with_shard(docs: DataFrame, key: str = "doc_id", weights: Sequence[float] = (1.0,) * SHARDS) -> DataFrame:
    """The rows with a column ``shard``, which replaces one of that name."""
    return docs.withColumn("shard", rendezvous(F.col(key), weights))

"""Joins and ranks that hold up when one key has a third of all rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType

from tallyfold.sources.shared import settle

BROADCAST_BYTES = 32 << 20
HOT_SHARE = 1024
SALTS = 64


@dataclass(frozen=True)
class KeyTable:
    """A written table with one row per key, and what was measured of it:
    an upper estimate of the bytes a broadcast takes, and the rows it stands for."""

    table: DataFrame
    weight: str | None
    size: float
    total: int

    def select(self, *columns) -> KeyTable:
        """Fewer or narrower columns, the weight among them."""
        return replace(self, table=self.table.select(*columns))

    def filter(self, condition: Column) -> KeyTable:
        return replace(self, table=self.table.filter(condition))

    def is_small(self, limit: int) -> bool:
        return self.size <= limit


def key_table(table: DataFrame, weight: str | None = "n_rows") -> KeyTable:
    """Write the table and measure what was written. Arrays, maps and structs are not
    measured; a table that has any is never taken for small."""
    nested = any(
        isinstance(field.dataType, (ArrayType, MapType, StructType)) for field in table.schema.fields
    )
    written = settle(table)
    seen = written.agg(
        F.coalesce(F.sum(_row_bytes(table)), F.lit(0)).alias("size"),
        F.coalesce(F.sum(weight or F.lit(0)), F.lit(0)).alias("total"),
    ).first()
    return KeyTable(written, weight, float("inf") if nested else seen["size"], seen["total"])


def _row_bytes(table: DataFrame) -> Column:
    """Upper estimate of the bytes a flat row takes in a broadcast."""
    width = F.lit(16 * len(table.columns) + 64)
    for field in table.schema.fields:
        if isinstance(field.dataType, (StringType, BinaryType)):
            width = width + 2 * F.coalesce(F.octet_length(field.name), F.lit(0))
    return width


def frequent_from(keys: KeyTable, limit: int) -> int | None:
    """The least weight from which on a flat table's keys fit a broadcast of ``limit``
    bytes together; None if no keys do. Weights must be positive.

    Keys are summed up by the logarithm of their weight, in steps of an eighth, so that
    a few hundred rows are brought to the driver whatever the table's size.
    """
    step = F.floor(F.log2(F.col(keys.weight)) * 8)
    steps = keys.table.groupBy(step.alias("step")).agg(
        F.sum(_row_bytes(keys.table)).alias("size"), F.min(keys.weight).alias("least")
    )
    least, size = None, 0
    for row in sorted(steps.collect(), key=lambda r: -r["step"]):
        size += row["size"]
        if size > limit:
            break
        least = row["least"]
    return least


def lookup_join(
    rows: DataFrame,
    keys: DataFrame | KeyTable,
    on: Sequence[str],
    spread: Sequence[str],
    weight: str | None = "n_rows",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Left join of many rows to a table with one row per key.

    ``weight`` is a column of the table: how many of ``rows`` have that key; it is
    dropped. Without one, the rows are counted if need be. A table measured below ``broadcast_bytes`` is broadcast. Beyond that,
    rows are shuffled by key, and each key with at least 1/HOT_SHARE of all rows
    (so no more than HOT_SHARE keys) is split into SALTS parts by a hash of the
    ``spread`` columns. Rows with a null key have no partner and are split too.
    """
    on = list(on)
    if not isinstance(keys, KeyTable):
        keys = key_table(keys, weight)
    values = keys.table.drop(keys.weight) if keys.weight else keys.table
    if keys.is_small(broadcast_bytes):
        return rows.join(F.broadcast(values), on, "left")

    # hot keys are known by a hash, 8 bytes each; a collision only splits a key more
    hashed = F.xxhash64(*on).alias("_key")
    if keys.weight:
        counts, total = keys.table.select(hashed, F.col(keys.weight).alias("_n")), keys.total
    else:
        counts, total = rows.groupBy(hashed).agg(F.count(F.lit(1)).alias("_n")), rows.count()
    hot = F.broadcast(
        counts.filter(F.col("_n") * HOT_SHARE >= F.lit(total)).select("_key", F.lit(True).alias("_hot")).distinct()
    )
    salt = F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int")
    no_key = F.lit(False)
    for name in on:
        no_key = no_key | F.col(name).isNull()

    def marked(df: DataFrame) -> DataFrame:
        return df.withColumn("_key", F.xxhash64(*on)).join(hot, "_key", "left").drop("_key")

    salted = (
        marked(rows)
        .withColumn(
            "_salt", F.when(F.col("_hot") | no_key, salt).otherwise(F.lit(0))
        )
        .drop("_hot")
    )
    copies = F.when(
        F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))
    ).otherwise(F.array(F.lit(0)))
    replicated = marked(values).withColumn("_salt", F.explode(copies)).drop("_hot")
    return salted.join(replicated, [*on, "_salt"], "left").drop("_salt")


def side_by_side(
    a: DataFrame,
    b: DataFrame,
    on: Sequence[str],
    from_a: Mapping[str, Column],
    from_b: Mapping[str, Column],
    unique: bool = False,
) -> DataFrame:
    """Full outer match of two tables with one row per key, by one grouped pass.

    Adds ``n_a`` and ``n_b``, the rows each side had. A repeated key is collapsed before
    the shuffle instead of multiplying, and of its values the largest is kept. With
    ``unique`` it is an error, raised when the row is read, since which of its rows counts
    can't be known; and rows with a null key, which match nothing, are left out.
    """
    on = list(on)
    types_a = dict(a.select(*[c.alias(n) for n, c in from_a.items()]).dtypes)
    types_b = dict(b.select(*[c.alias(n) for n, c in from_b.items()]).dtypes)
    names = [*types_a, *types_b]

    def tagged(df, n_a, n_b, given, types_other):
        return df.select(
            *on,
            F.lit(n_a).cast("bigint").alias("n_a"),
            F.lit(n_b).cast("bigint").alias("n_b"),
            *[c.alias(n) for n, c in given.items()],
            *[F.lit(None).cast(t).alias(n) for n, t in types_other.items()],
        )

    both = tagged(a, 1, 0, from_a, types_b).unionByName(
        tagged(b, 0, 1, from_b, types_a)
    )
    if unique:
        both = both.dropna("any", subset=on)
    matched = both.groupBy(*on).agg(
        F.sum("n_a").alias("n_a"),
        F.sum("n_b").alias("n_b"),
        *[F.max(n).alias(n) for n in names],
    )
    if not unique:
        return matched
    shown = F.concat_ws(", ", *[F.col(c).cast("string") for c in on])
    repeated = F.raise_error(F.concat(F.lit("repeated id "), shown)).cast("bigint")
    once = (F.col("n_a") <= 1) & (F.col("n_b") <= 1)
    return matched.withColumn("n_a", F.when(once, F.col("n_a")).otherwise(repeated))


def bucketed_rank(
    df: DataFrame,
    by: Sequence[str],
    buckets: Sequence[Column],
    order: Sequence[Column],
    name: str = "rank",
) -> DataFrame:
    """Exact ``row_number`` over (by, buckets, order), without a task per ``by`` group.

    ``buckets`` are expressions that come first in the order and cut a group into
    many parts. Rows are ranked inside their part; the sizes of the parts before it,
    a table with one row per part, are added. ``by`` must not be null.
    """
    parts = [f"_b{i}" for i in range(len(buckets))]
    cut = df
    for part, expr in zip(parts, buckets):
        cut = cut.withColumn(part, expr)
    keys = [*by, *parts]
    before = (
        Window.partitionBy(*by)
        .orderBy(*parts)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    sizes = cut.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select(
        *keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy(*keys).orderBy(*order)
    return (
        cut.join(offsets, keys)
        .withColumn(name, F.row_number().over(inside) + F.col("_before"))
        .drop(*parts, "_before")
    )


def running_sums(
    rows: DataFrame,
    by: Sequence[str],
    order: Sequence[str | Column],
    sums: Mapping[str, Column],
    parts: int | None = None,
) -> DataFrame:
    """Add inclusive running sums over (by, order), without a task per ``by`` group.

    Rows are cut into ranges of (by, order) and written with the number of their range. Sums
    run inside a range; those of the ranges before it, one row per (by, range), are added.
    ``order`` must tell rows apart, else equal ones share a range. ``by`` must not be null;
    null values add nothing.
    """
    spark = rows.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, *[F.col(c) for c in by], *order)
    cut = settle(ranged.withColumn("_part", F.spark_partition_id()))
    totals = cut.groupBy(*by, "_part").agg(*[F.sum(e).alias(n) for n, e in sums.items()])
    earlier = (
        Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = totals.select(
        *by, "_part", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_c_{n}") for n in sums]
    )
    inside = (
        Window.partitionBy(*by, "_part")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    joined = cut.join(carried, [*by, "_part"])
    return joined.select(
        *rows.columns,
        *[
            (F.coalesce(F.sum(e).over(inside), F.lit(0)) + F.col(f"_c_{n}")).alias(n)
            for n, e in sums.items()
        ],
    )


def previous_values(
    rows: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    values: Mapping[str, str],
    parts: int | None = None,
) -> DataFrame:
    """Add, under the new names, columns of the row before in (by, order); null for a group's
    first row. As in ``running_sums``, rows are cut into ranges; a range's first row of a
    group takes the last one of an earlier range. ``order`` must tell rows apart."""
    spark = rows.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, *[F.col(c) for c in (*by, *order)])
    cut = settle(ranged.withColumn("_part", F.spark_partition_id()))
    kept = F.struct(*[F.col(c).alias(n) for n, c in values.items()])
    lasts = cut.groupBy(*by, "_part").agg(F.max_by(kept, F.struct(*order)).alias("_last"))
    earlier = Window.partitionBy(*by).orderBy("_part")
    carried = lasts.select(*by, "_part", F.lag("_last").over(earlier).alias("_carried"))
    inside = Window.partitionBy(*by, "_part").orderBy(*order)
    first = F.row_number().over(inside) == 1
    return cut.join(carried, [*by, "_part"]).select(
        *rows.columns,
        *[
            F.when(first, F.col("_carried")[n]).otherwise(F.lag(c).over(inside)).alias(n)
            for n, c in values.items()
        ],
    )

"""Features of event logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.functions.text import template
from tallyfold.operators.skew import lookup_join
from tallyfold.sources.shared import settle


def log_counts(
    df: DataFrame, entity: str, ts: str = "ts", unit: str = "hour"
) -> DataFrame:
    """(entity, bucket, n) events per entity and time unit."""
    bucket = F.date_trunc(unit, ts).cast(df.schema[ts].dataType)
    return df.groupBy(entity, bucket.alias("bucket")).agg(
        F.count(F.lit(1)).alias("n")
    )


def zscore(
    df: DataFrame, value: str, by: str, spread: str, name: str = "z"
) -> DataFrame:
    """Add (value - mean) / stddev of the row's group; null for a group with no
    spread. The groups are aggregated first and joined back, so a very large group
    is never in one task."""
    stats = df.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.avg(value).alias("_mean"),
        F.stddev_samp(value).alias("_std"),
    )
    z = F.when(F.col("_std") > 0, (F.col(value) - F.col("_mean")) / F.col("_std"))
    return (
        lookup_join(df, stats, [by], [spread]).withColumn(name, z).drop("_mean", "_std")
    )


def rare_template(
    df: DataFrame, message: Column, max_share: float, by: Sequence[str], spread: str
) -> DataFrame:
    """Add template, template_n, template_share (within ``by``) and is_rare."""
    if not by:
        raise ValueError("name at least one column to take the share within")
    rows = df.withColumn("template", template(message))
    counts = settle(
        rows.groupBy(*by, "template").agg(F.count(F.lit(1)).alias("template_n"))
    )
    sizes = counts.groupBy(*by).agg(
        F.sum("template_n").alias("_all"), F.count(F.lit(1)).alias("n_rows")
    )
    table = lookup_join(counts, sizes, by, ["template"]).withColumn(
        "n_rows", F.col("template_n")
    )
    share = F.col("template_n") / F.col("_all")
    return (
        lookup_join(rows, table, [*by, "template"], [spread])
        .withColumn("template_share", share)
        .withColumn("is_rare", (share <= max_share).cast("int"))
        .drop("_all")
    )

"""How much of a score, or of a gain between two submissions, is chance."""

from __future__ import annotations

from collections.abc import Sequence
from math import exp, factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.operators.metrics import macro_f1_of
from tallyfold.operators.skew import side_by_side

BITS = 52
#: A 52-bit number at or above the k-th edge weighs more than k: the Poisson law of mean 1.
EDGES = [int(sum(exp(-1) / factorial(j) for j in range(k + 1)) * (1 << BITS)) for k in range(12)]


def poisson_weight(id_col: Column, replicate: Column) -> Column:
    """How often a row counts in a replicate: 0, 1, 2, .. by md5(id|replicate), so the same on
    every run and however the rows are partitioned. A null id is an id of its own ('')."""
    key = F.concat_ws("|", F.coalesce(id_col.cast("string"), F.lit("")), replicate.cast("string"))
    drawn = F.conv(F.substring(F.md5(key), 1, BITS // 4), 16, 10).cast("bigint")
    return sum([(drawn >= F.lit(e)).cast("bigint") for e in EDGES[1:]], (drawn >= F.lit(EDGES[0])).cast("bigint"))


def bootstrap_pair(
    a: DataFrame, b: DataFrame, classes: Sequence, replicates: int, id_col: str = "id", y: str = "y", y_hat: str = "y_hat"
) -> DataFrame:
    """(replicate, macro_f1_a, macro_f1_b, delta): the two submissions on the same resampled
    rows. ``a`` has the true classes; ids that either lacks are left out, repeated ones are an
    error. One pass: only weighted counts per replicate and classes are shuffled.
    """
    both = side_by_side(
        a, b, [id_col], {"y": F.col(y), "y_a": F.col(y_hat)}, {"y_b": F.col(y_hat)}, unique=True
    ).filter((F.col("n_a") > 0) & (F.col("n_b") > 0) & F.col("y").isNotNull())
    drawn = both.select(
        id_col, "y", "y_a", "y_b", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate")
    ).withColumn("n", poisson_weight(F.col(id_col), F.col("replicate")))
    cells = drawn.groupBy("replicate", "y", "y_a", "y_b").agg(F.sum("n").alias("n")).filter("n > 0")

    def scored(said: str, name: str) -> DataFrame:
        counts = cells.groupBy("replicate", "y", F.col(said).alias("y_hat")).agg(F.sum("n").alias("n"))
        found = macro_f1_of(counts, classes, ["replicate"])
        return found.select("replicate", F.col("macro_f1").alias(name))

    # one row a replicate
    return (
        scored("y_a", "macro_f1_a")
        .join(scored("y_b", "macro_f1_b"), "replicate")
        .withColumn("delta", F.col("macro_f1_b") - F.col("macro_f1_a"))
    )


def interval(replicates: DataFrame, column: str = "delta", level: float = 0.95) -> DataFrame:
    """(n_replicates, mean, low, high, share_above_0) of a column of the replicates."""
    tail = (1 - level) / 2
    return replicates.agg(
        F.count(F.lit(1)).alias("n_replicates"),
        F.avg(column).alias("mean"),
        F.percentile(column, F.lit(tail)).alias("low"),
        F.percentile(column, F.lit(1 - tail)).alias("high"),
        F.avg((F.col(column) > 0).cast("double")).alias("share_above_0"),
    )

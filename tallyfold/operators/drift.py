"""Drift of feature columns between two tables whose rows can't be matched by an id.

Exact figures come from the distinct values of a column, counted first and then scanned in
order. Sketches stand for a column in a few kilobytes: they are made in one pass without a sort,
kept, merged over days or parts, and compared later without the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.operators.skew import running_sums
from tallyfold.sources.shared import settle

BINS = 10
PRIOR = 0.5
SKETCH_K = 2000
POINTS = 400


def _values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value) of all numbers; null and NaN are left out, -0.0 is 0.0."""
    numbers = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    long = numbers.unpivot([], list(columns), "column", "value")
    return long.filter(F.col("value").isNotNull() & ~F.isnan("value")).withColumn(
        "value", F.col("value") + F.lit(0.0)
    )


def column_drift(a: DataFrame, b: DataFrame, columns: Sequence[str], bins: int = BINS) -> DataFrame:
    """(column, n_a, n_b, ks, psi) of each column that has a number on either side.

    ``ks``: the largest gap between the two shares of values up to a point. ``psi``: population
    stability index over ``bins`` bins that hold equal shares of ``a``; equal values share a
    bin, each bin's counts are raised by PRIOR, and bins without rows don't count. Both are
    null if a side has no numbers.
    """
    sides = (
        _values(a, columns)
        .select("column", "value", F.lit(1).alias("in_a"), F.lit(0).alias("in_b"))
        .union(_values(b, columns).select("column", "value", F.lit(0), F.lit(1)))
    )
    counted = settle(
        sides.groupBy("column", "value").agg(F.sum("in_a").alias("c_a"), F.sum("in_b").alias("c_b"))
    )
    # one row per column
    totals = counted.groupBy("column").agg(F.sum("c_a").alias("n_a"), F.sum("c_b").alias("n_b"))
    summed = running_sums(counted, ["column"], ["value"], {"to_a": F.col("c_a"), "to_b": F.col("c_b")})
    gap = F.abs(F.try_divide("to_a", "n_a") - F.try_divide("to_b", "n_b"))
    cut = F.floor(F.try_divide(F.lit(bins) * (F.col("to_a") - F.col("c_a")), F.col("n_a")))
    per_bin = (
        summed.join(F.broadcast(totals), "column")
        .groupBy("column", "n_a", "n_b", F.least(cut, F.lit(bins - 1)).alias("bin"))
        .agg(F.sum("c_a").alias("c_a"), F.sum("c_b").alias("c_b"), F.max(gap).alias("gap"))
    )
    share_a = (F.col("c_a") + PRIOR) / (F.col("n_a") + PRIOR * bins)
    share_b = (F.col("c_b") + PRIOR) / (F.col("n_b") + PRIOR * bins)
    index = F.sum((share_a - share_b) * F.ln(share_a / share_b))
    both = (F.col("n_a") > 0) & (F.col("n_b") > 0)
    return per_bin.groupBy("column", "n_a", "n_b").agg(
        F.max("gap").alias("ks"), F.when(both, index).alias("psi")
    )


def column_sketches(df: DataFrame, columns: Sequence[str], k: int = SKETCH_K) -> DataFrame:
    """(column, n, sketch): a quantile sketch of each column that has numbers."""
    return (
        _values(df, columns)
        .groupBy("column")
        .agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double("value", F.lit(k)).alias("sketch"))
    )


def merge_sketches(sketches: DataFrame, k: int = SKETCH_K) -> DataFrame:
    """(column, n, sketch) of all rows behind several tables of sketches, united before."""
    return sketches.groupBy("column").agg(
        F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch")
    )


def rank_error(k: int) -> float:
    """How far a rank read from a sketch is off, at 99 % confidence."""
    return 2.296 / k**0.9021


def sketched_ks(a: DataFrame, b: DataFrame, points: int = POINTS, k: int = SKETCH_K) -> DataFrame:
    """(column, n_a, n_b, ks, error) of the columns that both tables of sketches have.

    The quantiles that are 1 / ``points`` apart stand for a side. The gap is taken at those of
    both sides; a share there is the last quantile that is not above. ``error``: what lies
    between two points of either side, and the rank errors of both sketches for the points and
    for the shares.
    """
    at = F.array(*[F.lit(i / points) for i in range(points + 1)])
    left, right = [
        side.select(
            "column", F.col("n").alias(f"n_{name}"), F.kll_sketch_get_quantile_double("sketch", at).alias(f"_{name}")
        )
        for name, side in (("a", a), ("b", b))
    ]

    def share(quantiles: str) -> Column:
        not_above = F.size(F.filter(quantiles, lambda q: q <= F.col("_v")))
        return F.greatest(not_above - 1, F.lit(0)) / points

    # one row per column and point
    gaps = (
        left.join(right, "column")
        .withColumn("_v", F.explode(F.concat("_a", "_b")))
        .withColumn("_gap", F.abs(share("_a") - share("_b")))
    )
    error = 2.0 / points + 4 * rank_error(k)
    return gaps.groupBy("column", "n_a", "n_b").agg(F.max("_gap").alias("ks")).withColumn("error", F.lit(error))

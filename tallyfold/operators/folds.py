"""Fold assignment and out-of-fold scoring."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.functions.hashing import content_key, hash_mod
from tallyfold.operators.skew import bucketed_rank, lookup_join


def assign_folds(
    df: DataFrame,
    k: int,
    group: Sequence[str],
    seed: str = "",
    name: str = "fold",
    portable: bool = True,
) -> DataFrame:
    """Fold from a hash of the content columns: no shuffle, and equal content is
    always in one fold. ``portable`` folds can be repeated by other engines, the
    others are much cheaper."""
    key = F.col(group[0]) if len(group) == 1 else content_key(*map(F.col, group))
    return df.withColumn(name, hash_mod(key, k, seed, portable))


def stratified_folds(
    df: DataFrame, k: int, group: str, y: str, spread: str, name: str = "fold"
) -> DataFrame:
    """Folds that hold nearly equal numbers of groups of every class.

    A group takes its most common class (lowest on ties; none if all its rows are
    unlabelled). The groups of a class are ranked by hash and dealt out in turn.
    """
    stratum = F.coalesce(F.col(y).cast("string"), F.lit(""))
    labelled = F.col(y).isNotNull()
    keyed = df.withColumn("_group", F.md5(F.coalesce(F.col(group).cast("string"), F.lit(""))))
    votes = keyed.groupBy("_group", stratum.alias("_stratum")).agg(
        F.count(F.lit(1)).alias("_n"),
        F.max(labelled).alias("_labelled"),
    )
    groups = votes.groupBy("_group").agg(
        F.sum("_n").alias("n_rows"),
        F.min_by("_stratum", F.struct(~F.col("_labelled"), -F.col("_n"), F.col("_stratum"))).alias(
            "_stratum"
        ),
    )
    ranked = bucketed_rank(
        groups,
        ["_stratum"],
        [F.substring("_group", 1, 4)],
        [F.col("_group")],
        "_rank",
    )
    folds = ranked.select(
        "_group", "n_rows", ((F.col("_rank") - 1) % k).cast("int").alias(name)
    )
    return lookup_join(keyed, folds, ["_group"], [spread]).drop("_group")


def oof(
    df: DataFrame,
    k: int,
    fit: Callable[[DataFrame], Callable[[DataFrame], DataFrame]],
    fold: str = "fold",
) -> DataFrame:
    """Out-of-fold scores: k fits, each scoring the fold it has not seen. A row with a null
    fold, or one outside 0 .. k-1, is an error, raised when rows are read."""
    wrong = F.raise_error(F.lit(f"folds must be 0 .. {k - 1}")).cast("int")
    sound = df.withColumn(fold, F.when(F.col(fold).between(0, k - 1), F.col(fold)).otherwise(wrong))

    def one(f: int) -> DataFrame:
        scorer = fit(sound.filter(F.col(fold) != f))
        return scorer(sound.filter(F.col(fold) == f))

    return reduce(DataFrame.unionByName, [one(f) for f in range(k)])


def oof_score(
    df: DataFrame,
    k: int,
    fit: Callable[[DataFrame], Callable[[DataFrame], DataFrame]],
    metric: Callable[[DataFrame], DataFrame],
    fold: str = "fold",
) -> DataFrame:
    """A metric of the out-of-fold predictions, pooled over the folds (not the mean of
    the folds' own scores)."""
    return metric(oof(df, k, fit, fold))


def smoke_sample(df: DataFrame, per_class: int, y: str, id_col: str) -> DataFrame:
    """The first ``per_class`` rows of every class by md5 of the id.

    The rows of a class are counted in 65,536 parts by the md5; only the parts that hold the
    first rows are ranked, each part for itself. No task gets a class.
    """
    cut = df.withColumn("_m", F.md5(F.col(id_col).cast("string"))).withColumn(
        "_part", F.coalesce(F.substring("_m", 1, 4), F.lit(""))
    )
    before = (
        Window.partitionBy(y).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    )
    parts = (
        cut.groupBy(y, "_part")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .filter(F.col("_before") < per_class)
        .select(F.col(y).alias("_y"), F.col("_part").alias("_p"), "_before")
    )
    inside = Window.partitionBy(y, "_part").orderBy("_m", id_col)
    kept = cut.join(parts, F.col(y).eqNullSafe(F.col("_y")) & (F.col("_part") == F.col("_p")))
    return (
        kept.withColumn("_rank", F.row_number().over(inside) + F.col("_before"))
        .filter(F.col("_rank") <= per_class)
        .select(*df.columns)
    )

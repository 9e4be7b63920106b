"""Checks on a submission before it is handed in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.operators.skew import side_by_side


def check_submission(
    submission: DataFrame,
    expected: DataFrame,
    classes: Sequence,
    id_col: str = "id",
    y_hat: str = "y_hat",
) -> DataFrame:
    """One row: n_expected, n_submitted, missing, extra, duplicated, bad_class, valid.

    missing/extra/duplicated count ids; bad_class counts ids with a null class or one
    outside the list.
    """
    bad = F.coalesce(~F.col(y_hat).isin(list(classes)), F.lit(True)).cast("int")
    ids = side_by_side(submission, expected, [id_col], {"bad": bad}, {})
    in_sub, in_exp = F.col("n_a") > 0, F.col("n_b") > 0

    def count(condition):
        return F.coalesce(F.sum(condition.cast("bigint")), F.lit(0))

    totals = ids.agg(
        count(in_exp).alias("n_expected"),
        F.coalesce(F.sum("n_a"), F.lit(0)).alias("n_submitted"),
        count(in_exp & ~in_sub).alias("missing"),
        count(in_sub & ~in_exp).alias("extra"),
        count(F.col("n_a") > 1).alias("duplicated"),
        count(F.col("bad") == 1).alias("bad_class"),
    )
    faults = F.col("missing") + F.col("extra") + F.col("duplicated") + F.col("bad_class")
    return totals.withColumn("valid", faults == 0)


def validation_report(checks: DataFrame, metrics: DataFrame) -> DataFrame:
    """(metric, value): the checks and scores of one-row tables in long form."""

    def long(df: DataFrame) -> DataFrame:
        wide = df.select(*[F.col(c).cast("double").alias(c) for c in df.columns])
        return wide.unpivot([], wide.columns, "metric", "value")

    return long(checks).unionByName(long(metrics))

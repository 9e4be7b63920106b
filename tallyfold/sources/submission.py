"""Submissions as CSV, reports as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUBMISSION_SCHEMA = "id bigint, y_hat string"


def write_submission(df: DataFrame, path: str, id_col: str = "id") -> None:
    df.select(F.col(id_col).alias("id"), F.col("y_hat").cast("string")).write.csv(
        path, header=True, mode="errorifexists"
    )


def read_submission(
    spark: SparkSession, path: str, schema: str = SUBMISSION_SCHEMA
) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=True, mode="FAILFAST")


def write_report(metrics: DataFrame, path: str) -> None:
    """One JSON object per line."""
    metrics.write.json(path, mode="errorifexists")


def read_report(
    spark: SparkSession, path: str, schema: str = "metric string, value double"
) -> DataFrame:
    return spark.read.json(path, schema=schema, mode="FAILFAST")

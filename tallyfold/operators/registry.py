"""Versions, records and logs of projects."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.functions.versions import version_key
from tallyfold.sources.shared import settle

# The fields every iteration record has.
RECORD_FIELDS = (
    "date",
    "project",
    "version",
    "archive_path",
    "model_file",
    "result_file",
    "root_clean",
    "note",
)
SEGMENT = 64


def latest_version(registry: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """(project, version, carry..) of the highest version. Unreadable names don't take
    part; ``unreadable_versions`` lists them. A grouped maximum, so a project with very many
    rows is reduced before the shuffle."""
    key = version_key(F.col("version"))
    top = F.max(F.struct(key.alias("key"), F.col("version"), *carry)).alias("top")
    return (
        registry.groupBy("project")
        .agg(top)
        .filter(F.col("top.key").isNotNull())
        .select("project", "top.version", *[f"top.{c}" for c in carry])
    )


def unreadable_versions(registry: DataFrame) -> DataFrame:
    """(project, version, n) of the names that are no version, nulls too."""
    return (
        registry.filter(version_key(F.col("version")).isNull())
        .groupBy("project", "version")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def version_delta(registry: DataFrame) -> DataFrame:
    """(project, metric, version, score, delta_points, best_before, regression).

    delta_points is 100 x the gain over the previous version; a regression scores
    below the best of all earlier versions. Of a version logged twice the last entry
    (``logged_at``) counts, the higher score if the times are equal. Input:
    project, metric, version, logged_at, score.

    The version order is followed inside segments of SEGMENT minor numbers; a table
    with one row per segment carries the last and the best score across them.
    """
    logged = registry.groupBy("project", "metric", "version").agg(
        F.max(F.struct("logged_at", "score"))["score"].alias("score")
    )
    entries = (
        settle(logged)
        .withColumn("_v", version_key(F.col("version")))
        .filter(F.col("_v").isNotNull())
        .withColumn("_major", F.col("_v.major"))
        .withColumn("_part", F.floor(F.col("_v.minor") / SEGMENT))
    )
    line = ["project", "metric"]
    segment = [*line, "_major", "_part"]
    across = Window.partitionBy(*line).orderBy("_major", "_part")
    carried = (
        entries.groupBy(*segment)
        .agg(
            F.max(F.struct("_v", "score"))["score"].alias("_last"),
            F.max("score").alias("_best"),
        )
        .select(
            *segment,
            F.lag("_last").over(across).alias("_carry_last"),
            F.max("_best")
            .over(across.rowsBetween(Window.unboundedPreceding, -1))
            .alias("_carry_best"),
        )
    )
    inside = Window.partitionBy(*segment).orderBy("_v")
    earlier = F.max("score").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    previous = F.coalesce(F.lag("score").over(inside), F.col("_carry_last"))
    return (
        entries.join(carried, segment)
        .withColumn("_previous", previous)
        .withColumn("best_before", F.greatest(earlier, F.col("_carry_best")))
        .select(
            "project",
            "metric",
            "version",
            "score",
            ((F.col("score") - F.col("_previous")) * 100.0).alias("delta_points"),
            "best_before",
            F.coalesce(F.col("score") < F.col("best_before"), F.lit(False)).alias(
                "regression"
            ),
        )
    )


def score_gap(registry: DataFrame, local: str, platform: str) -> DataFrame:
    """(project, version, local_score, platform_score, gap_points) where both exist. Of an
    entry logged twice the last counts, the higher score if the times are equal."""

    def of(m):
        last = F.max(F.when(F.col("metric") == m, F.struct("logged_at", "score")))
        return last["score"]

    both = (
        registry.filter(F.col("metric").isin(local, platform))
        .groupBy("project", "version")
        .agg(of(local).alias("local_score"), of(platform).alias("platform_score"))
    )
    gap = (F.col("local_score") - F.col("platform_score")) * 100.0
    return both.withColumn("gap_points", gap).filter(F.col("gap_points").isNotNull())


def check_records(
    records: DataFrame, id_col: str, required: Sequence[str] = RECORD_FIELDS
) -> DataFrame:
    """(id, field, problem) for every required field that is null or blank."""
    problems = [
        F.when(
            F.col(f).isNull(),
            F.struct(F.lit(f).alias("field"), F.lit("null").alias("problem")),
        ).when(
            F.trim(F.col(f)) == "",
            F.struct(F.lit(f).alias("field"), F.lit("blank").alias("problem")),
        )
        for f in required
    ]
    return records.select(id_col, F.inline(F.array_compact(F.array(*problems))))


def index_vs_log(index: DataFrame, log: DataFrame) -> DataFrame:
    """(project, index_version, log_version, status): does the index agree with the
    latest version the log mentions? Status: same, differs, only_index, only_log."""
    def side(df: DataFrame, a: int) -> DataFrame:
        key = version_key(F.col("version"))
        return df.select(
            "project",
            F.lit(a).alias("_side"),
            F.when(
                key.isNotNull(), F.struct(key.alias("key"), F.col("version").alias("version"))
            ).alias("_v"),
        )

    def latest(a: int):
        return F.max(F.when(F.col("_side") == a, F.col("_v")))["version"]

    both = (
        side(index, 0)
        .unionByName(side(log, 1))
        .groupBy("project")
        .agg(latest(0).alias("index_version"), latest(1).alias("log_version"))
        .filter(F.col("project").isNotNull())
        .filter(F.coalesce("index_version", "log_version").isNotNull())
    )
    status = (
        F.when(F.col("log_version").isNull(), "only_index")
        .when(F.col("index_version").isNull(), "only_log")
        .when(F.col("index_version") == F.col("log_version"), "same")
        .otherwise("differs")
    )
    return both.withColumn("status", status)

"""File manifests: totals, comparison, leftovers. Nothing is moved or deleted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.operators.registry import latest_version
from tallyfold.operators.skew import lookup_join, side_by_side

# Names of temporary files, and a version inside a file name.
LEFTOVER_PATTERNS = (r"(^|/)smoke_[^/]*$",)
FILE_VERSION = r"_(v[0-9]+\.[0-9]+)(?:[._][^/]*)?$"


def totals(manifest: DataFrame) -> DataFrame:
    """(n_files, n_bytes)."""
    return manifest.agg(
        F.count(F.lit(1)).alias("n_files"),
        F.coalesce(F.sum("length"), F.lit(0)).alias("n_bytes"),
    )


def relative(manifest: DataFrame, root: str) -> DataFrame:
    """Paths with the root (and a scheme such as ``file:``) taken off."""
    plain = F.regexp_replace("path", r"^[a-z0-9]+:/*(?=/)", "")
    base = F.lit(root.rstrip("/") + "/")
    return manifest.withColumn(
        "path",
        F.when(plain.startswith(base), F.substr(plain, F.length(base) + 1)).otherwise(
            plain
        ),
    )


def reconcile(a: DataFrame, b: DataFrame, sha: str | None = None) -> DataFrame:
    """(path, length_a, length_b, status): added, removed, changed or same.

    Same means equal length, and equal hash when ``sha`` names the hash column.
    """
    with_hash = [sha] if sha else []
    both = side_by_side(
        a,
        b,
        ["path"],
        {"length_a": F.col("length"), **{f"{c}_a": F.col(c) for c in with_hash}},
        {"length_b": F.col("length"), **{f"{c}_b": F.col(c) for c in with_hash}},
        unique=True,
    )
    equal = F.col("length_a") == F.col("length_b")
    for c in with_hash:
        equal = equal & F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b"))
    status = (
        F.when(F.col("n_a") == 0, "added")
        .when(F.col("n_b") == 0, "removed")
        .when(equal, "same")
        .otherwise("changed")
    )
    return both.select("path", "length_a", "length_b", status.alias("status"))


def reconcile_totals(diff: DataFrame) -> DataFrame:
    """(status, n_files, bytes_a, bytes_b)."""
    return diff.groupBy("status").agg(
        F.count(F.lit(1)).alias("n_files"),
        F.coalesce(F.sum("length_a"), F.lit(0)).alias("bytes_a"),
        F.coalesce(F.sum("length_b"), F.lit(0)).alias("bytes_b"),
    )


def find_leftovers(
    manifest: DataFrame,
    registry: DataFrame,
    patterns: Sequence[str] = LEFTOVER_PATTERNS,
) -> DataFrame:
    """(project, path, reason) of files that do not belong in the active area.

    temporary: the name fits a pattern. historic: the name carries a version that is
    not the project's current one. ``manifest``: project, path.
    """
    temporary = F.lit(False)
    for p in patterns:
        temporary = temporary | F.col("path").rlike(p)
    version = F.regexp_extract("path", FILE_VERSION, 1)
    files = manifest.select(
        "project",
        "path",
        temporary.alias("_temporary"),
        F.nullif(version, F.lit("")).alias("_version"),
    )
    current = latest_version(registry).withColumnRenamed("version", "_current")
    reason = F.when(F.col("_temporary"), "temporary").when(
        F.col("_version") != F.col("_current"), "historic"
    )
    return (
        lookup_join(files, current, ["project"], ["path"], weight=None)
        .withColumn("reason", reason)
        .filter(F.col("reason").isNotNull())
        .select("project", "path", "reason")
    )

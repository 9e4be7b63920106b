"""File trees compared as trees: folders by a digest of what is below, files that moved.

A folder's digest is a sum of hashes of (path below the folder, content) over all its files, so
it is added up before the shuffle; no task sees the list of a folder's files, and levels need no
jobs of their own. Equal trees have equal digests wherever they stand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.operators.manifests import reconcile
from tallyfold.operators.skew import lookup_join, running_sums, side_by_side
from tallyfold.sources.shared import settle

HEX_DIGITS = 15


def _hash_number(text: Column) -> Column:
    """A number of 60 bits."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, HEX_DIGITS), 16, 10).cast("decimal(20,0)")


def folder_totals(manifest: DataFrame, sha: str) -> DataFrame:
    """(folder, n_files, n_bytes, digest) of every folder, the root as ''; files below its
    folders count. ``manifest``: path, length, and the hash of the content, null if unknown; files
    of unknown content count by their length. The digest is a text."""
    parts = F.split("path", "/")
    depth = F.explode(F.sequence(F.lit(0), F.size(parts) - 1))
    rows = manifest.select("length", F.col(sha).alias("_sha"), parts.alias("_parts"), depth.alias("_depth"))
    folder = F.array_join(F.slice("_parts", 1, F.col("_depth")), "/")
    below = F.array_join(F.slice("_parts", F.col("_depth") + 1, F.size("_parts")), "/")
    content = F.coalesce("_sha", F.concat(F.lit("?"), F.coalesce(F.col("length").cast("string"), F.lit("?"))))
    return (
        rows.select(folder.alias("folder"), "length", _hash_number(F.concat_ws("\n", below, content)).alias("_h"))
        .groupBy("folder")
        .agg(
            F.count(F.lit(1)).alias("n_files"),
            F.coalesce(F.sum("length"), F.lit(0)).alias("n_bytes"),
            F.sum("_h").cast("string").alias("digest"),
        )
    )


def folder_diff(a: DataFrame, b: DataFrame, sha: str) -> DataFrame:
    """(folder, n_files_a, n_files_b, n_bytes_a, n_bytes_b, status, same_as).

    Status: added, removed, changed or same, by the digests. ``same_as``: for an added folder,
    the first folder of ``a`` that holds the very same tree, for a removed one the first of ``b``.
    """
    total_a, total_b = settle(folder_totals(a, sha)), settle(folder_totals(b, sha))
    both = side_by_side(
        total_a,
        total_b,
        ["folder"],
        {f"{c}_a": F.col(c) for c in ("n_files", "n_bytes", "digest")},
        {f"{c}_b": F.col(c) for c in ("n_files", "n_bytes", "digest")},
        unique=True,
    )
    status = (
        F.when(F.col("n_a") == 0, "added")
        .when(F.col("n_b") == 0, "removed")
        .when(F.col("digest_a") == F.col("digest_b"), "same")
        .otherwise("changed")
    )

    def known(totals: DataFrame, side: str) -> DataFrame:
        return totals.groupBy("digest").agg(F.min("folder").alias("same_as")).withColumn("status", F.lit(side))

    # a folder that only one side has is looked up among the trees of the other
    trees = known(total_a, "added").union(known(total_b, "removed"))
    rows = both.withColumn("status", status).withColumn("digest", F.coalesce("digest_a", "digest_b"))
    return lookup_join(rows, trees, ["digest", "status"], ["folder"], weight=None).select(
        "folder", "n_files_a", "n_files_b", "n_bytes_a", "n_bytes_b", "status", "same_as"
    )


def moves(a: DataFrame, b: DataFrame, sha: str) -> DataFrame:
    """(path, path_b, length_a, length_b, status): ``reconcile`` with moved files.

    A removed and an added file of equal length and hash are one moved file. Where several
    have one content, they are paired in the order of their paths, and what is left over stays
    removed or added. Files of unknown content don't move. ``path`` is null for added files,
    ``path_b`` for removed ones.
    """
    diff = settle(reconcile(a, b, sha))

    def numbered(status: str, manifest: DataFrame, length: str) -> DataFrame:
        paths = diff.filter(F.col("status") == status).select("path")
        files = manifest.select("path", F.col("length").alias(length), F.col(sha).alias("_sha")).join(paths, "path")
        # running counts run in ranges: one content may be a third of all files
        known = files.filter(F.col("_sha").isNotNull() & F.col(length).isNotNull())
        ranked = running_sums(known, ["_sha", length], ["path"], {"_r": F.lit(1)})
        unknown = files.filter(F.col("_sha").isNull() | F.col(length).isNull())
        return ranked.union(unknown.withColumn("_r", F.lit(None).cast("bigint")))

    removed = numbered("removed", a, "length_a")
    added = numbered("added", b, "length_b").withColumnsRenamed({"path": "path_b", "_sha": "_sha_b", "_r": "_r_b"})
    paired = removed.join(
        added,
        (F.col("_sha") == F.col("_sha_b"))
        & (F.col("length_a") == F.col("length_b"))
        & (F.col("_r") == F.col("_r_b")),
        "full",
    )
    status = F.when(F.col("path").isNull(), "added").when(F.col("path_b").isNull(), "removed").otherwise("moved")
    stayed = diff.filter(F.col("status").isin("same", "changed"))
    return stayed.select("path", F.col("path").alias("path_b"), "length_a", "length_b", "status").union(
        paired.select("path", "path_b", "length_a", "length_b", status)
    )

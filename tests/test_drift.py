"""Drift of columns, and files and folders that moved."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tallyfold.operators import drift, trees


def _frame(spark, rows, schema="x double, z double"):
    return spark.createDataFrame(rows, schema)


def _brute(a, b, bins=10):
    a, b = sorted(v for v in a if v is not None and v == v), sorted(v for v in b if v is not None and v == v)
    if not a or not b:
        return None, None
    values = sorted(set(a) | set(b))
    ks = max(abs(sum(v <= c for v in a) / len(a) - sum(v <= c for v in b) / len(b)) for c in values)
    bin_of = {c: min(bins - 1, bins * sum(v < c for v in a) // len(a)) for c in values}
    psi = 0.0
    for k in set(bin_of.values()):
        p = (sum(bin_of[v] == k for v in a) + 0.5) / (len(a) + 0.5 * bins)
        q = (sum(bin_of[v] == k for v in b) + 0.5) / (len(b) + 0.5 * bins)
        psi += (p - q) * math.log(p / q)
    return ks, psi


@pytest.mark.parametrize("seed", [1, 2])
def test_column_drift_against_brute_force(spark, seed):
    draw = random.Random(seed)
    a = [(draw.choice([None, float("nan"), draw.gauss(0, 1)]), float(draw.randrange(4))) for _ in range(300)]
    b = [(draw.choice([None, draw.gauss(0.5, 2)]), float(draw.randrange(6)) - 0.0) for _ in range(200)]
    found = drift.column_drift(_frame(spark, a), _frame(spark, b), ["x", "z"]).collect()
    assert {r["column"] for r in found} == {"x", "z"}
    for r in found:
        i = "xz".index(r["column"])
        ks, psi = _brute([row[i] for row in a], [row[i] for row in b])
        assert r["ks"] == pytest.approx(ks, abs=1e-12) and r["psi"] == pytest.approx(psi, abs=1e-9)


def test_drift_without_numbers(spark):
    a, none = _frame(spark, [(1.0, None), (2.0, None)]), _frame(spark, [(None, None)])
    found = drift.column_drift(a, none, ["x", "z"]).collect()
    assert [(r["column"], r["n_a"], r["n_b"], r["ks"], r["psi"]) for r in found] == [("x", 2, 0, None, None)]
    empty = _frame(spark, [])
    assert drift.column_drift(empty, empty, ["x"]).collect() == []
    assert drift.sketched_ks(drift.column_sketches(a, ["x"]), drift.column_sketches(none, ["x"])).collect() == []


def test_sketches_merge_and_stay_within_their_error(spark):
    rows = spark.range(40_000).select((F.hash("id") % 10_000).cast("double").alias("x"), "id")
    a = rows.filter("id % 3 = 0")
    b = rows.filter("id % 3 != 0").withColumn("x", F.col("x") * 1.2 + 500)
    parts = [drift.column_sketches(b.filter(F.col("id") % 7 == i), ["x"]) for i in range(7)]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.union(part)
    read = drift.sketched_ks(drift.column_sketches(a, ["x"]), drift.merge_sketches(merged)).first()
    exact = drift.column_drift(a, b, ["x"]).first()
    assert (read["n_a"], read["n_b"]) == (exact["n_a"], exact["n_b"])
    assert abs(read["ks"] - exact["ks"]) <= read["error"]


MANIFEST = "path string, length bigint, sha string"


def test_moved_files(spark):
    a = [("a/x", 1, "s1"), ("a/y", 2, "s2"), ("b/z", 3, "s3"), ("c/one", 0, "e"), ("c/two", 0, "e"), ("k", 5, None)]
    b = [("a/x", 1, "s1"), ("n/y", 2, "s2"), ("b/z", 4, "s4"), ("d/one", 0, "e"), ("d/two", 0, "e"), ("d/three", 0, "e"), ("l", 5, None)]
    found = trees.moves(_frame(spark, a, MANIFEST), _frame(spark, b, MANIFEST), "sha").collect()
    assert {(r["path"], r["path_b"], r["status"]) for r in found} == {
        ("a/x", "a/x", "same"),
        ("a/y", "n/y", "moved"),
        ("b/z", "b/z", "changed"),
        ("c/one", "d/one", "moved"),
        ("c/two", "d/three", "moved"),
        (None, "d/two", "added"),
        ("k", None, "removed"),
        (None, "l", "added"),
    }


def test_many_equal_files_move(spark):
    files = spark.range(3000).select(F.format_string("%05d", "id").alias("n"), (F.col("id") % 3 == 0).alias("hot"))
    sha = F.when(F.col("hot"), F.lit("same")).otherwise(F.col("n"))
    a = files.select(F.concat(F.lit("old/"), "n").alias("path"), F.lit(1).cast("bigint").alias("length"), sha.alias("sha"))
    b = files.select(F.concat(F.lit("new/"), "n").alias("path"), F.lit(1).cast("bigint").alias("length"), sha.alias("sha"))
    found = trees.moves(a, b, "sha")
    assert found.filter("status = 'moved' and substr(path, 5) = substr(path_b, 5)").count() == 3000


def test_folders(spark):
    a = [("r/a/x", 1, "1"), ("r/a/y", 2, "2"), ("r/b/x", 1, "1"), ("r/b/y", 2, "2"), ("r/c/q", 7, "7"), ("top", 1, "t")]
    b = [("r/a/x", 1, "1"), ("r/a/y", 2, "2"), ("r/d/x", 1, "1"), ("r/d/y", 2, "2"), ("r/c/q", 7, "8"), ("top", 1, "t")]
    ours, theirs = _frame(spark, a, MANIFEST), _frame(spark, b, MANIFEST)
    totals = {r["folder"]: (r["n_files"], r["n_bytes"], r["digest"]) for r in trees.folder_totals(ours, "sha").collect()}
    assert {f: t[:2] for f, t in totals.items()} == {"": (6, 14), "r": (5, 13), "r/a": (2, 3), "r/b": (2, 3), "r/c": (1, 7)}
    assert totals["r/a"][2] == totals["r/b"][2] != totals["r/c"][2]
    found = trees.folder_diff(ours, theirs, "sha").collect()
    assert {(r["folder"], r["status"], r["same_as"]) for r in found} == {
        ("", "changed", None),
        ("r", "changed", None),
        ("r/a", "same", None),
        ("r/b", "removed", "r/a"),
        ("r/c", "changed", None),
        ("r/d", "added", "r/a"),
    }
    assert trees.folder_diff(_frame(spark, [], MANIFEST), _frame(spark, [], MANIFEST), "sha").collect() == []

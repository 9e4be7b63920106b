"""Null, repeated, hidden and unlisted inputs."""

import pytest
from pyspark.errors import PySparkException
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tallyfold.functions.scores import gated_decide
from tallyfold.operators import align, ensemble, folds, keys, manifests, metrics, registry, scorers
from tallyfold.operators.skew import key_table
from tallyfold.sources import files, run_log


def test_a_lookup_leaves_binary_scoring_alone(spark):
    key_table(spark.createDataFrame([("a", 1)], "key string, n_rows bigint"))
    rows = spark.range(60).select(
        "id",
        (F.col("id") % 2).cast("int").alias("y"),
        array_to_vector(F.array((F.col("id") % 2) * 1.0, F.lit(1.0))).alias("features"),
    )
    model = scorers.fit_scorer(rows, "logistic", 2)
    got = scorers.score_with(model, rows, 2, keep=["id", "y"]).collect()
    assert len({r.id for r in got}) == 60
    assert all(abs(sum(r.probs) - 1) < 1e-9 and (r.probs[1] > 0.5) == (r.y == 1) for r in got)


def test_a_gate_without_a_score_decides_nothing(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (0.9,), (0.1,)], "p double")
    probs = F.array(F.lit(0.0), F.lit(0.2), F.lit(0.8))
    got = df.select(gated_decide(F.col("p"), probs, 0.5, 3).alias("c")).collect()
    assert [r.c for r in got] == [None, None, 2, 0]


def test_features_are_compared_in_their_own_type(spark):
    big = 1 << 53
    a = spark.createDataFrame([(1, "x", big, 1.0, [1]), (2, "y", 7, 2.0, [2])], "id bigint, s string, n bigint, t double, v array<int>")
    b = spark.createDataFrame([(1, "x", big + 1, "1.0", [1]), (2, "z", 7, "two", [3])], "id bigint, s string, n bigint, t string, v array<int>")
    got = {r.column: (r.status, r.n_mismatch) for r in align.compare_features(a, b, "id").collect()}
    assert got == {"s": ("same", 1), "n": ("same", 1), "t": ("type", 1), "v": ("same", 1)}


def test_matches_leave_out_null_ids_and_refuse_repeats(spark):
    schema = "id bigint, y_hat string"
    a = spark.createDataFrame([(None, "A"), (1, "A"), (2, "B")], schema)
    b = spark.createDataFrame([(None, "C"), (1, "B"), (3, "B")], schema)
    assert [tuple(r) for r in metrics.flip_matrix(a, b).collect()] == [("A", "B", 1)]
    with pytest.raises(PySparkException, match="repeated id 1"):
        metrics.flip_matrix(a.union(a), b).collect()
    paths = spark.createDataFrame([("p", 1), ("p", 2)], "path string, length bigint")
    with pytest.raises(PySparkException, match="repeated id p"):
        manifests.reconcile(paths, paths).collect()


def test_two_seeds_of_a_candidate_are_refused(spark):
    rows = [(1, "a", 0, 0, [1.0]), (1, "a", 1, 0, [0.0])]
    long = spark.createDataFrame(rows, "id bigint, candidate string, seed int, view int, probs array<double>")
    with pytest.raises(PySparkException, match="several scores of candidate a for id 1"):
        ensemble.wide_scores(long, ["a"]).collect()


def test_the_last_entry_of_a_version_counts(spark):
    rows = [("p", "v1.0", "local", 1, 0.9), ("p", "v1.0", "local", 2, 0.5), ("p", "v1.0", "web", 1, 0.4), ("p", "x", "web", 1, 0.1)]
    log = spark.createDataFrame(rows, "project string, version string, metric string, logged_at int, score double")
    got = registry.score_gap(log.filter("version != 'x'"), "local", "web").first()
    assert (got.local_score, round(got.gap_points, 6)) == (0.5, 10.0)
    assert [tuple(r) for r in registry.unreadable_versions(log).collect()] == [("p", "x", 1)]


def test_a_tables_head_and_rule_are_no_projects(spark):
    lines = spark.createDataFrame([("| project | note |",), ("|---|---|",), ("| mail | v1.2 ok |",)], "line string")
    assert [r.project for r in run_log.parse_run_log(lines).collect()] == [None, None, "mail"]


def test_an_unlisted_true_class_is_refused(spark):
    rows = spark.createDataFrame([(1, "k", 0, 0), (2, "k", 9, 1)], "id bigint, key string, y int, fold int")
    with pytest.raises(PySparkException, match="not among the classes"):
        keys.lookup_confusion(rows, "key", "y", "fold", [0, 1], 2).collect()


@pytest.mark.parametrize("fold", [None, 2, -1])
def test_out_of_fold_scores_need_a_fold(spark, fold):
    rows = spark.createDataFrame([(1, 0), (2, 1), (3, fold)], "id bigint, fold int")
    with pytest.raises(PySparkException, match="folds must be"):
        folds.oof(rows, 2, lambda train: lambda test: test).collect()


def test_300_classes(spark):
    k = 300
    rows = spark.range(3000).select(
        "id",
        F.concat(F.lit("k"), F.col("id") % 40).alias("key"),
        (F.col("id") % k).cast("int").alias("y"),
        (F.col("id") % 7 % 3).cast("int").alias("fold"),
    )
    by_counts = keys.lookup_confusion(rows, "key", "y", "fold", list(range(k)), 3)
    by_rows = metrics.confusion(keys.lookup_candidate(rows, "key", "y", "fold", list(range(k)), "id", 3))
    columns = ["y", "y_hat", "n"]
    assert sorted(map(tuple, by_counts.select(*columns).collect())) == sorted(map(tuple, by_rows.select(*columns).collect()))


def test_hidden_files_are_listed(spark, tmp_path):
    for name in ("_x/a", ".y", "_x/.z/b c", "empty", "plain"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"" if name == "empty" else name.encode())
    total = manifests.totals(files.manifest(spark, str(tmp_path))).first()
    assert tuple(total) == (5, 4 + 2 + 9 + 5)
    got = manifests.relative(files.contents(spark, str(tmp_path)), str(tmp_path)).collect()
    assert {r.path: bytes(r.content) for r in got} == {
        n: b"" if n == "empty" else n.encode() for n in ("_x/a", ".y", "_x/.z/b c", "empty", "plain")
    }

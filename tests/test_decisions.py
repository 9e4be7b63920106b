import random

import pytest
from pyspark.sql import functions as F

from tallyfold.operators import decisions


def test_sweep_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(rng.choice([0.0, 0.08, 0.5, 1.0, rng.random()]), rng.randrange(2)) for _ in range(400)]
    rows += [(None, 1), (0.3, None), (float("nan"), 0)]
    grid = [0.5, 0.08, 0.2, 1.0, 0.0]
    df = spark.createDataFrame(rows, "p double, y int").repartition(4)
    got = {r.threshold: r for r in decisions.threshold_sweep(df, grid).collect()}
    assert sorted(got) == sorted(grid)
    f1s = {}
    for th, r in got.items():
        kept = [(p, y) for p, y in rows if y is not None]
        hit = lambda p: p is not None and p == p and p >= th  # noqa: E731, B023
        want = (
            sum(y == 1 and hit(p) for p, y in kept),
            sum(y == 0 and hit(p) for p, y in kept),
            sum(y == 1 and not hit(p) for p, y in kept),
            sum(y == 0 and not hit(p) for p, y in kept),
        )
        assert (r.tp, r.fp, r.fn, r.tn) == want
        f1s[th] = 2 * want[0] / (2 * want[0] + want[1] + want[2])
        assert r.f1 == pytest.approx(f1s[th])
    best = [th for th, r in got.items() if r.best]
    assert best == [max(sorted(f1s), key=lambda th: f1s[th])]


def pool(spark):
    return spark.createDataFrame(
        [
            (1, [0.7, 0.3], 0),
            (2, [0.1, 0.9], 1),
            (3, [0.31, 0.69], None),
            (4, [0.95, 0.05], 1),
            (5, [0.5, 0.5], 0),
        ],
        "id bigint, probs array<double>, y int",
    )


def test_pseudo_labels_include_the_threshold(spark):
    got = {r.id: r.y_hat for r in decisions.pseudo_label(pool(spark), 0.7, 2).collect()}
    assert got == {1: 0, 2: 1, 4: 0}
    got = {r.id for r in decisions.pseudo_label(pool(spark), 0.9, 2).collect()}
    assert got == {2, 4}


def test_cap_keeps_the_surest_of_each_class(spark):
    df = spark.range(3000).select(
        "id",
        F.when(F.col("id") % 3 == 0, 1.0).otherwise(0.5 + (F.col("id") % 500) / 1000).alias("p"),
    )
    df = df.select("id", F.array(F.col("p"), 1 - F.col("p")).alias("probs"))
    got = decisions.pseudo_label(df, 0.7, 2, per_class_cap=1200).collect()
    assert len(got) == 1200
    assert sum(r.confidence == 1.0 for r in got) == 1000
    rest = sorted(r.confidence for r in got if r.confidence < 1.0)
    every = sorted(0.5 + (i % 500) / 1000 for i in range(3000) if i % 3)
    assert rest == pytest.approx(every[-200:])


def test_coverage_falls_with_the_threshold(spark):
    rows = decisions.pseudo_coverage(pool(spark), [0.5, 0.7, 0.9, 0.99], 2).collect()
    got = [r.coverage for r in sorted(rows, key=lambda r: r.threshold)]
    assert got == [1.0, 0.6, 0.4, 0.0]


def test_bands(spark):
    rows = decisions.confidence_bands(pool(spark), [0.7, 0.9], 2).collect()
    got = {r.band: (r.lower, r.n, r.n_right) for r in rows}
    assert got == {0: (0.0, 1, 1), 1: (0.7, 1, 1), 2: (0.9, 2, 1)}


def test_true_labels_win(spark):
    labelled = spark.createDataFrame([(1, 0), (2, 0)], "id bigint, y int")
    pseudo = decisions.pseudo_label(pool(spark), 0.7, 2)
    got = {r.id: (r.y, r.weight, r.is_pseudo) for r in decisions.with_pseudo(labelled, pseudo, 0.5).collect()}
    assert got == {1: (0, 1.0, 0), 2: (0, 1.0, 0), 4: (0, 0.5, 1)}

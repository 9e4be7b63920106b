import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tallyfold.operators import ensemble

LONG = "id bigint, candidate string, seed int, view int, probs array<double>"


def long_scores(spark, n=60, k=3, seeds=(0, 1)):
    rng = random.Random(5)
    rows = []
    for i in range(n):
        for c in "ab":
            for s in seeds:
                p = [rng.random() for _ in range(k)]
                rows.append((i, c, s, 0, [x / sum(p) for x in p]))
    return rows, spark.createDataFrame(rows, LONG)


def test_mean_over_seeds(spark):
    rows, df = long_scores(spark)
    got = {(r.id, r.candidate): r.probs for r in ensemble.mean_over_seeds(df, 3).collect()}
    for i, c in got:
        own = [r[4] for r in rows if r[0] == i and r[1] == c]
        assert got[i, c] == pytest.approx([sum(x) / 2 for x in zip(*own)])
        assert sum(got[i, c]) == pytest.approx(1.0)


def test_weighted_ensemble(spark):
    rows, df = long_scores(spark, n=5)
    weights = spark.createDataFrame(
        [("a", 0, 1.0), ("a", 1, 0.0), ("b", 0, 3.0), ("b", 1, 0.0)],
        "candidate string, seed int, weight double",
    )
    got = ensemble.weighted_ensemble(df, weights, ["candidate", "seed"], 3)
    for r in got.collect():
        a = next(x[4] for x in rows if x[:3] == (r.id, "a", 0))
        b = next(x[4] for x in rows if x[:3] == (r.id, "b", 0))
        assert r.probs == pytest.approx([(p + 3 * q) / 4 for p, q in zip(a, b)])


def test_missing_candidate_fails(spark):
    df = spark.createDataFrame(
        [(1, "a", 0, 0, [1.0]), (1, "b", 0, 0, [1.0]), (2, "a", 0, 0, [1.0])], LONG
    )
    with pytest.raises(PySparkException, match="no scores of candidate b for id 2"):
        ensemble.wide_scores(df, ["a", "b"]).collect()


def test_simplex_weights():
    grid = ensemble.simplex_weights(4, 10)
    assert len(grid) == 286 == len(set(grid))
    assert all(sum(w) == 10 for w in grid)
    assert grid == sorted(grid)
    with pytest.raises(ValueError):
        ensemble.simplex_weights(6, 100)


def brute_macro_f1(rows, weights, k):
    tp, true, pred = [0] * k, [0] * k, [0] * k
    for y, arrays in rows:
        mix = [sum(w * a[c] for w, a in zip(weights, arrays)) for c in range(k)]
        steps = [int((m * 1e9 + 0.5) // 1) for m in mix]
        best = steps.index(max(steps))
        true[y] += 1
        pred[best] += 1
        tp[y] += best == y
    return sum(2 * t / (a + b) if a + b else 0.0 for t, a, b in zip(tp, true, pred)) / k


def test_simplex_search_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, rng.randrange(3), *[[rng.random() for _ in range(3)] for _ in range(3)]) for i in range(80)]
    rows.append((80, None, [1.0, 0.0, 0.0], [1.0, 0.0, 0.0], [1.0, 0.0, 0.0]))
    wide = spark.createDataFrame(
        rows, "id bigint, y int, a array<double>, b array<double>, c array<double>"
    ).repartition(3)
    grid = ensemble.simplex_weights(3, 5)
    labelled = [(r[1], r[2:]) for r in rows if r[1] is not None]
    scores = [brute_macro_f1(labelled, [p / 5 for p in w], 3) for w in grid]
    got = ensemble.search_weights(wide, ["a", "b", "c"], [[p / 5 for p in w] for w in grid], 3)
    assert {r.w_index: round(r.macro_f1, 9) for r in got.collect()} == {
        i: round(s, 9) for i, s in enumerate(scores)
    }
    top = ensemble.simplex_search(wide, ["a", "b", "c"], 3, steps=5, top=3).collect()
    assert [r["rank"] for r in top] == [1, 2, 3]
    best = max(range(len(grid)), key=lambda i: (round(scores[i], 9), -i))
    assert [top[0].w_a, top[0].w_b, top[0].w_c] == [p / 5 for p in grid[best]]
    closer = ensemble.best_weights(wide, ["a", "b", "c"], 3, steps=5, refine=1)
    assert sum(closer) == pytest.approx(1.0)
    assert brute_macro_f1(labelled, closer, 3) >= max(scores) - 1e-12


def test_fuse_is_the_searched_mixture(spark):
    df = spark.createDataFrame([([0.2, 0.8], [0.6, 0.4])], "a array<double>, b array<double>")
    got = df.select(ensemble.fuse(["a", "b"], [0.25, 0.75], 2).alias("m")).first().m
    assert got == pytest.approx([0.5, 0.5])


def test_guard_and_selection(spark):
    base = spark.createDataFrame([(i, int(i < 10)) for i in range(100)], "id bigint, y_hat int")
    rows = [("good", i, int(i < 11)) for i in range(100)] + [
        ("wild", i, int(i < 40)) for i in range(100)
    ]
    cand = spark.createDataFrame(rows, "candidate string, id bigint, y_hat int")
    guard = ensemble.guard_class_count(base, cand, 1, 0.8, 1.25)
    assert {r.candidate: (r.n_base, r.n_candidate, r.passes) for r in guard.collect()} == {
        "good": (10, 11, True),
        "wild": (10, 40, False),
    }
    scores = spark.createDataFrame(
        [("wild", 0.9), ("good", 0.7), ("fine", 0.8)], "candidate string, macro_f1 double"
    )
    picked = ensemble.select_candidate(scores, guard)
    got = {r.candidate: (r["rank"], r.selected) for r in picked.collect()}
    # a candidate without a guard result does not pass
    assert got == {"good": (1, True), "wild": (2, False), "fine": (3, False)}
    tie = spark.createDataFrame([("b", 0.5), ("a", 0.5)], "candidate string, macro_f1 double")
    chosen = ensemble.select_candidate(tie).filter(F.col("selected")).first()
    assert chosen.candidate == "a"

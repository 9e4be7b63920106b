"""Histogram boosting against a plain recursive version, on values instead of histograms."""

import math
import random

import numpy as np
import pytest

from tallyfold.operators import boosting

FIELDS = "id bigint, y int, x array<double>, fold int"


def samples(seed, n=150, d=4, k=3):
    dice = random.Random(seed)
    rows = []
    for i in range(n):
        y = dice.randrange(k)
        x = [dice.gauss(y * (f == y), 1.0) for f in range(d - 1)] + [float(dice.randrange(3))]
        if dice.random() < 0.1:
            x[dice.randrange(d)] = dice.choice([None, float("nan")])
        rows.append((i, None if i % 17 == 0 else y, x, i % 3))
    rows += [(n, 1, None, 0), (n + 1, 2, [0.5], 1), (n + 2, 9, [0.0] * d, 0), (n + 3, -1, [0.0] * d, 0)]
    return rows


def value(x, f):
    v = None if x is None or f >= len(x) else x[f]
    return -math.inf if v is None or math.isnan(v) else v


def fit_by_hand(rows, k, d, rounds, depth, n_bins, rate=0.3, penalty=1.0, min_rows=5):
    """Trees as nested tuples (feature, edge, left, right) or a leaf's value. Missing values
    are below all others."""
    known = [(y, [value(x, f) for f in range(d)]) for _, y, x, _ in rows if y is not None and 0 <= y < k]
    edges = []
    for f in range(d):
        v = sorted(x[f] for _, x in known if x[f] > -math.inf)
        found = {v[math.ceil(len(v) * i / n_bins) - 1] for i in range(1, n_bins)} if v else set()
        edges.append([-math.inf, *sorted(found)])
    margins = [[0.0] * k for _ in known]
    trees = []
    for _ in range(rounds):
        grads = []
        for (y, _), m in zip(known, margins):
            e = np.exp(np.array(m) - max(m))
            p = e / e.sum()
            grads.append([
                (math.floor((p[c] - (y == c)) * 2**20 + 0.5), math.floor(p[c] * (1 - p[c]) * 2**20 + 0.5)) for c in range(k)
            ])

        def grow(c, at, left_levels):
            g, h = (sum(grads[i][c][j] for i in at) for j in (0, 1))
            best = (1e-9, None)
            for f in range(d if left_levels else 0):
                for edge in edges[f]:
                    left = [i for i in at if known[i][1][f] <= edge]
                    if len(left) < min_rows or len(at) - len(left) < min_rows:
                        continue
                    gl, hl = (sum(grads[i][c][j] for i in left) for j in (0, 1))
                    gain = (
                        gl * gl / (hl + penalty * 2**20) + (g - gl) ** 2 / (h - hl + penalty * 2**20) - g * g / (h + penalty * 2**20)
                    ) / 2**20
                    if gain > best[0] + 1e-12:
                        best = (gain, (f, edge, left))
            if best[1] is None:
                return -rate * g / (h + penalty * 2**20)
            f, edge, left = best[1]
            rest = sorted(set(at) - set(left))
            return (f, edge, grow(c, left, left_levels - 1), grow(c, rest, left_levels - 1))

        trees.append([grow(c, list(range(len(known))), depth) for c in range(k)])
        for (_, x), m in zip(known, margins):
            for c in range(k):
                m[c] += leaf_of(trees[-1][c], x)
    return trees


def leaf_of(tree, x):
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


@pytest.mark.parametrize(("seed", "write_every"), [(0, 8), (1, 1)])
def test_three_rounds_by_hand(spark, seed, write_every):
    rows = samples(seed)
    df = spark.createDataFrame(rows, FIELDS).repartition(4)
    model = boosting.fit_boosted(df, 3, 4, rounds=3, depth=3, n_bins=12, write_every=write_every)
    trees = fit_by_hand(rows, 3, 4, rounds=3, depth=3, n_bins=12)
    got = {r["id"]: r["probs"] for r in boosting.boosted_scores(df, model).collect()}
    assert len(got) == len(rows)
    for i, _, x, _ in rows:
        values = [value(x, f) for f in range(4)]
        m = np.array([sum(leaf_of(t[c], values) for t in trees) for c in range(3)])
        e = np.exp(m - m.max())
        assert got[i] == pytest.approx(list(e / e.sum()), abs=1e-12)


def test_partitions_dont_matter(spark):
    df = spark.createDataFrame(samples(2), FIELDS)
    splits = [
        boosting.first_splits(df.repartition(n), 3, 4, depth=3, n_bins=8).orderBy("class", "node").collect()
        for n in (1, 9)
    ]
    assert splits[0] == splits[1] and len(splits[0]) > 5
    root = [s for s in splits[0] if s["node"] == 1]
    assert all(s["n"] == root[0]["n"] for s in root)


def test_learns_and_is_kept(spark, tmp_path):
    rows = samples(3, n=400)
    df = spark.createDataFrame(rows, FIELDS)
    model = boosting.fit_boosted(df.filter("fold > 0"), 3, 4, rounds=6, depth=2, n_bins=16)
    out = boosting.boosted_scores(df.filter("fold = 0 and y between 0 and 2"), model).collect()
    assert np.mean([int(np.argmax(r["probs"])) == r["y"] for r in out]) > 0.45
    assert all(abs(sum(r["probs"]) - 1) < 1e-12 for r in out)
    boosting.save_boosted(model, spark, str(tmp_path / "m"))
    again = boosting.load_boosted(spark, str(tmp_path / "m"))
    assert sorted(map(str, boosting.boosted_scores(df, again).collect())) == sorted(
        map(str, boosting.boosted_scores(df, model).collect())
    )


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([], FIELDS)
    model = boosting.fit_boosted(df, 3, 4, rounds=2)
    assert boosting.boosted_scores(df, model).collect() == []
    one = spark.createDataFrame([(1, 0, [1.0, 1.0, 1.0, 1.0], 0)] * 20, FIELDS)
    probs = boosting.boosted_scores(one, model).first()["probs"]
    assert probs == pytest.approx([1 / 3] * 3)
    model = boosting.fit_boosted(one, 3, 4, rounds=2)
    assert model.trees[0][0][0] == {} and boosting.boosted_scores(one, model).first()["probs"][0] > 0.4
    assert boosting.first_splits(df, 3, 4).collect() == []
    with pytest.raises(ValueError):
        boosting.fit_boosted(df, 3, 4, n_bins=1000)

"""Line search and greedy selection against trying everything."""

import math
import random

import numpy as np
import pytest

from tallyfold.operators import fusion


def macro(truth, said, k):
    f1 = []
    for c in range(k):
        both = sum(t == c for t in truth) + sum(s == c for s in said)
        f1.append(2 * sum(t == s == c for t, s in zip(truth, said)) / both if both else 0.0)
    return sum(f1) / k


def table_of(seed, n, m, k, coarse=False):
    dice = random.Random(seed)
    rows = []
    for i in range(n):
        y = dice.choice([None, k + 2, *range(k), *range(k), *range(k)])
        probs = []
        for _ in range(m):
            p = [dice.random() + (c == y) * 0.3 for c in range(k)]
            p = [round(v / sum(p), 1 if coarse else 12) for v in p]
            probs.append(p)
        rows.append((i, y, *probs))
    return rows


def best_by_hand(rows, start, end, k):
    """Macro-F1 between all crossings of any two lines of any row."""
    kept = [r for r in rows if r[1] is not None]
    lines = []
    for r in kept:
        q = np.floor(np.array(r[2:]) * 1e9 + 0.5)
        a, b = np.array(start) @ q, np.array(end) @ q
        lines.append((a, b - a))
    cuts = {0, 10**9}
    for a, b in lines:
        for i in range(k):
            for j in range(k):
                if b[j] > b[i] and 0 <= (a[i] - a[j]) / (b[j] - b[i]) < 1:
                    cuts.add(math.floor((a[i] - a[j]) / (b[j] - b[i]) * 1e9 + 0.5))
    cuts = sorted(cuts)
    tried = []
    for lo, hi in zip(cuts, cuts[1:]):
        t = (lo + hi) / 2e9
        said = [int(np.argmax(a + t * b)) for a, b in lines]
        tried.append((macro([r[1] for r in kept], said, k), t))
    top = max(f for f, _ in tried)
    return top, min(t for f, t in tried if f > top - 1e-10), tried


@pytest.mark.parametrize(("seed", "m", "k", "coarse"), [(0, 3, 4, False), (1, 2, 6, False), (2, 3, 3, True)])
def test_line_search_by_hand(spark, seed, m, k, coarse):
    rows, names = table_of(seed, 40, m, k, coarse), [f"m{i}" for i in range(m)]
    wide = spark.createDataFrame(rows, "id int, y int, " + ", ".join(f"{n} array<double>" for n in names)).repartition(3)
    start = [1 / m] * m
    found = {r["towards"]: r for r in fusion.line_search(wide, names, start, k).collect()}
    assert set(found) == set(names)
    for i, name in enumerate(names):
        end = [float(i == j) for j in range(m)]
        top, t, tried = best_by_hand(rows, start, end, k)
        assert found[name]["macro_f1"] == pytest.approx(top, abs=1e-9)
        assert found[name]["start_f1"] == pytest.approx(tried[0][0], abs=1e-9)
        # the found place lies in an interval as good, none before it is
        reached = min(tried, key=lambda x: abs(x[1] - found[name]["t"]))
        assert reached[0] == pytest.approx(top, abs=1e-9) and found[name]["t"] >= t - 1e-9


def test_ascent_ends_where_no_line_leads_higher(spark):
    rows, names = table_of(5, 60, 3, 3), ["m0", "m1", "m2"]
    wide = spark.createDataFrame(rows, "id int, y int, m0 array<double>, m1 array<double>, m2 array<double>")
    weights, path = fusion.ascend(wide, names, 3)
    assert sum(weights) == pytest.approx(1) and path == sorted(path) and len(path) > 1
    kept = [r for r in rows if r[1] is not None]
    mixed = [np.array(weights) @ np.floor(np.array(r[2:]) * 1e9 + 0.5) for r in kept]
    assert macro([r[1] for r in kept], [int(np.argmax(v)) for v in mixed], 3) == pytest.approx(path[-1], abs=1e-9)
    for i in range(3):
        top, _, _ = best_by_hand(rows, weights, [float(i == j) for j in range(3)], 3)
        assert top <= path[-1] + 1e-9


def test_no_labelled_rows(spark):
    schema = "id int, y int, m0 array<double>, m1 array<double>"
    wide = spark.createDataFrame([(1, None, [0.5, 0.5], [0.1, 0.9])], schema)
    assert fusion.line_search(wide, ["m0", "m1"], [0.5, 0.5], 2).collect() == []
    assert fusion.ascend(wide, ["m0", "m1"], 2) == ([0.5, 0.5], [])


def test_greedy_by_hand(spark):
    k, models = 4, [("a", 0), ("a", 1), ("b", 0), ("c", 2)]
    rows = table_of(3, 50, 4, k)
    long = [(r[0], r[1], *models[j], r[2 + j]) for r in rows for j in range(4)]
    df = spark.createDataFrame(long, "id int, y int, candidate string, seed int, probs array<double>").repartition(5)
    got = [tuple(r) for r in fusion.greedy_selection(df, k, steps=6).collect()]
    kept = [r for r in rows if r[1] is not None]
    inside = [r for r in kept if r[1] < k]
    q = {j: np.array([np.floor(np.array(r[2 + j]) * 1e9 + 0.5) for r in inside]) for j in range(4)}
    total, want = np.zeros((len(inside), k)), []
    for step in range(1, 7):
        f1 = [macro([r[1] for r in inside], (total + q[j]).argmax(axis=1).tolist(), k) for j in range(4)]
        best = max(range(4), key=lambda j: (round(f1[j] * 1e9), -j))
        total = total + q[best]
        want.append((step, *models[best], pytest.approx(f1[best])))
    assert got == want


def test_greedy_refuses_gaps(spark):
    schema = "id int, y int, candidate string, seed int, probs array<double>"
    rows = [(1, 0, "a", 0, [0.5, 0.5]), (1, 0, "b", 0, [0.5, 0.5]), (2, 1, "a", 0, [0.5, 0.5])]
    with pytest.raises(Exception, match="missing or repeated scores for id 2"):
        fusion.greedy_selection(spark.createDataFrame(rows, schema), 2).collect()
    assert fusion.greedy_selection(spark.createDataFrame([], schema), 2).collect() == []

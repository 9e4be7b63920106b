"""Threshold curves and isotonic calibration against plain versions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tallyfold.operators import curves

SCORES = "id int, y int, p double, fold int"


def scores(seed, n=300, levels=40):
    dice = random.Random(seed)
    rows = []
    for i in range(n):
        p = dice.randrange(levels) / levels
        y = None if dice.random() < 0.1 else int(dice.random() < p)
        rows.append((i, y, dice.choice([p, p, p, p, None, float("nan")]), dice.choice([0, 1, 2, 2, None, 7])))
    return rows


def missing(p):
    return p is None or math.isnan(p)


def test_curve_and_summary(spark):
    rows = scores(0)
    df = spark.createDataFrame(rows, SCORES).repartition(4)
    known = [(y, -1.0 if missing(p) else p) for _, y, p, _ in rows if y is not None]
    pos, neg = sum(y == 1 for y, _ in known), sum(y != 1 for y, _ in known)
    got = {round(r["threshold"], 9): r for r in curves.threshold_curve(df).collect()}
    assert set(got) == {round(p, 9) for _, p in known if p >= 0}
    for t, r in got.items():
        tp, fp = sum(y == 1 and p >= t for y, p in known), sum(y != 1 and p >= t for y, p in known)
        assert (r["tp"], r["fp"], r["fn"], r["tn"]) == (tp, fp, pos - tp, neg - fp)
        assert r["f1"] == pytest.approx(2 * tp / (tp + fp + pos))
    one = curves.threshold_summary(df).first()
    best = max(got.values(), key=lambda r: (round(r["f1"] * 1e9), -r["threshold"]))
    assert (one["best_threshold"], one["n_thresholds"]) == (best["threshold"], len(got))
    pairs = [(a > b) + (a == b) / 2 for ya, a in known if ya == 1 for yb, b in known if yb != 1]
    assert one["roc_auc"] == pytest.approx(sum(pairs) / len(pairs))
    hits = sum(got[round(p, 9)]["precision"] for y, p in known if y == 1 and p >= 0)
    assert one["average_precision"] == pytest.approx(hits / pos)


def test_curves_of_one_class_or_nothing(spark):
    empty = curves.threshold_summary(spark.createDataFrame([], SCORES)).first()
    assert tuple(empty) == (0, None, None, None, None)
    df = spark.createDataFrame([(1, 0, 0.5, 0), (2, 0, 0.7, 0)], SCORES)
    one = curves.threshold_summary(df).first()
    assert one["best_f1"] == 0.0 and one["roc_auc"] is None and one["best_threshold"] == 0.5
    assert all(r["recall"] is None for r in curves.threshold_curve(df).collect())


def pooled_by_hand(counts):
    """[(from, to, n, pos)] of rising shares, from sorted (q, n, pos)."""
    blocks = [[q, q, n, p] for q, n, p in counts]
    i = 0
    while i + 1 < len(blocks):
        a, b = blocks[i], blocks[i + 1]
        if a[3] * b[2] >= b[3] * a[2]:
            blocks[i : i + 2] = [[a[0], b[1], a[2] + b[2], a[3] + b[3]]]
            i = max(0, i - 1)
        else:
            i += 1
    return [tuple(b) for b in blocks]


def cases():
    dice = random.Random(7)
    yield [(i, 5, 5 * (i % 2)) for i in range(60)]
    yield [(i, 60, 60 - i) for i in range(60)]
    yield [(i, 60, i) for i in range(60)]
    yield [(i, 10, 3) for i in range(50)]
    yield [(3, 4, 2)]
    for _ in range(3):
        yield [(i, n, dice.randrange(n + 1)) for i in range(80) for n in [dice.randrange(1, 9)]]
    yield [(i, 10, 10 if i < 30 else 0) for i in range(60)]


def test_blocks_by_hand(spark):
    every = list(cases())
    rows = [(g, q, n, p) for g, counts in enumerate(every) for q, n, p in counts]
    df = spark.createDataFrame(rows, "g int, q bigint, n bigint, pos bigint")
    for parts in (1, 23):
        got = curves.isotonic_blocks(df.repartition(5), ["g"], parts).collect()
        for g, counts in enumerate(every):
            mine = sorted(tuple(r)[1:] for r in got if r["g"] == g)
            assert mine == pooled_by_hand(counts), (g, parts)


def test_a_task_holds_two_ranges_at_most(spark):
    """A falling sequence pools into one block over all ranges, pair by pair."""
    rows = [(0, i, 1000, 1000 - i) for i in range(600)]
    df = spark.createDataFrame(rows, "g int, q bigint, n bigint, pos bigint")
    got = curves.isotonic_blocks(df, ["g"], 20).collect()
    assert [tuple(r)[1:] for r in got] == [(0, 599, 600_000, sum(r[3] for r in rows))]


def test_calibrated_out_of_fold(spark):
    rows = scores(2, n=400)
    got = {r["id"]: r for r in curves.calibrated_oof(spark.createDataFrame(rows, SCORES).repartition(4), 3, parts=5).collect()}
    assert len(got) == len(rows)

    def step(p):
        return math.floor(p * 1e9 + 0.5)

    for i, y, p, fold in rows:
        own = fold if y is not None and fold in (0, 1, 2) else -1
        assert got[i]["fold"] == own
        if missing(p):
            assert got[i]["calibrated"] is None
            continue
        learnt = [(step(q), z) for _, z, q, f in rows if z is not None and f in (0, 1, 2) and f != own and not missing(q)]
        counts = sorted({q for q, _ in learnt})
        blocks = pooled_by_hand([(q, sum(x == q for x, _ in learnt), sum(z for x, z in learnt if x == q)) for q in counts])
        below = [b for b in blocks if b[0] <= step(p)] or blocks[:1]
        assert got[i]["calibrated"] == pytest.approx(below[-1][3] / below[-1][2])


def test_threshold_for_a_precision(spark):
    rows = [(0, q, 10, q) for q in range(1, 10)] + [(1, 1, 10, 2)]
    df = spark.createDataFrame(rows, "fold int, q bigint, n bigint, pos bigint")
    blocks = curves.isotonic_blocks(df.withColumn("q", F.col("q") * 100_000_000), ["fold"])
    got = {r["fold"]: r["threshold"] for r in curves.threshold_for(blocks, 0.7).collect()}
    assert got == {0: pytest.approx(0.7)}


def test_no_rows_to_calibrate(spark):
    assert curves.calibrated_oof(spark.createDataFrame([], SCORES), 3).collect() == []
    lone = spark.createDataFrame([(1, 1, 0.5, 0)], SCORES)
    assert curves.calibrated_oof(lone, 3).first()["calibrated"] is None

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tallyfold.functions.scores import argmax_class
from tallyfold.operators import decisions, folds, metrics, scorers


def points(spark, n=240, k=3, dims=6):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(k, dims)) * 2
    rows = []
    for i in range(n):
        y = i % k
        x = centres[y] + rng.normal(size=dims)
        rows.append((i, None if i % 11 == 0 else y, [float(v) for v in x], int(rng.integers(4))))
    return rows, spark.createDataFrame(rows, "id bigint, y int, x array<double>, fold int")


def test_centroids_against_numpy(spark):
    rows, df = points(spark)
    model = scorers.fit_centroids(df, "x", "y", "fold", 4)
    got = scorers.score_centroids(
        df, model, "x", ["id"], "fold", [("all", 0, range(6)), ("half", 1, [0, 2, 4])]
    ).collect()
    assert len(got) == 2 * len(rows)
    dims = {"all": list(range(6)), "half": [0, 2, 4]}
    for r in got:
        _, _, x, fold = rows[r.id]
        logits = []
        for c in range(3):
            near = [p[2] for p in rows if p[1] == c and p[3] != fold]
            gap = (np.array(x) - np.mean(near, axis=0))[dims[r.candidate]]
            logits.append(-(gap**2).sum())
        e = np.exp(np.array(logits) - max(logits))
        assert r.probs == pytest.approx([*(e / e.sum()), 0.0])


def brute_bayes(rows, k):
    words = {i: re.findall(r"[^\W_]+", t.lower()) for i, t, _, _ in rows}
    vocab = {w for i, _, y, _ in rows if y is not None for w in words[i]}
    out = {}
    for i, _, y, fold in rows:
        others = [r for r in rows if r[2] is not None and (y is None or r[3] != fold)]
        logits = []
        for c in range(k):
            n = Counter(w for r in others if r[2] == c for w in words[r[0]])
            docs = sum(r[2] == c for r in others)
            s = math.log((docs + 1) / (len(others) + k))
            s += sum(math.log((n[w] + 1) / (sum(n.values()) + len(vocab))) for w in words[i])
            logits.append(s)
        e = [math.exp(s - max(logits)) for s in logits]
        out[i] = [v / sum(e) for v in e]
    return out


def test_naive_bayes_both_ways(spark):
    texts = ["the cat sat", "The dog ran the", "cat cat dog", "", "a the zebra", "dog the cat x1", "the"]
    rows = [
        (i, texts[i % 7] + (" the" * (i % 4)), (None if i % 9 == 4 else (i * 5 // 3) % 2), i % 3)
        for i in range(60)
    ]
    df = spark.createDataFrame(rows, "id bigint, text string, y int, fold int")
    want = brute_bayes(rows, 2)
    for limit in (1 << 30, 0):
        got = scorers.naive_bayes_scores(df, "id", "text", "y", "fold", 2, 3, broadcast_bytes=limit)
        rows_got = got.collect()
        assert len(rows_got) == 60
        for r in rows_got:
            assert r.probs == pytest.approx(want[r.id], rel=1e-9, abs=1e-12)


def test_naive_bayes_sends_rare_tokens_only(spark, monkeypatch):
    rows = [(i, f"the cat sat the r{i} r{i}", None if i % 4 == 3 else i % 2, i % 3) for i in range(40)]
    df = spark.createDataFrame(rows, "id bigint, text string, y int, fold int")
    sent, join = [], scorers.lookup_join

    def counting(sides, *args, **kwargs):
        sent.append(sides.count())
        return join(sides, *args, **kwargs)

    monkeypatch.setattr(scorers, "lookup_join", counting)
    # room for the, cat and sat in each fold
    got = scorers.naive_bayes_scores(df, "id", "text", "y", "fold", 2, 3, broadcast_bytes=2500)
    want = brute_bayes(rows, 2)
    assert {r.id: r.probs for r in got.collect()} == {i: pytest.approx(p, rel=1e-9) for i, p in want.items()}
    # a row for each text and one for its own token; it was one for each token of each text
    assert sent == [80]


def test_pseudo_labels_count_labelled_texts_only(spark, monkeypatch):
    rows = [(i, f"{'cat' if i % 2 else 'dog'} u{i}", i % 2 if i < 10 else None, i % 5) for i in range(50)]
    df = spark.createDataFrame(rows, "id bigint, text string, y int, fold int")
    counted, counts = [], scorers.fold_counts

    def counting(sides, *args, **kwargs):
        counted.append(sides.count())
        return counts(sides, *args, **kwargs)

    monkeypatch.setattr(scorers, "fold_counts", counting)
    scores = scorers.naive_bayes_scores(df, "id", "text", "y", "fold", 2, 5, broadcast_bytes=0)
    labelled = scores.filter("y is not null").select("id", "y")
    sure = decisions.pseudo_label(scores, 0.7, 2)
    got = decisions.with_pseudo(labelled, sure, 0.5).collect()
    assert {r.id: (r.y, r.is_pseudo) for r in got} == {i: (i % 2, int(i >= 10)) for i in range(50)}
    # two tokens and the text itself; it was 150, the pool's too
    assert counted == [30]


def test_naive_bayes_sums_known_tokens_without_a_shuffle(spark, monkeypatch):
    texts = ["The CAT_sat", "the ÄRGER x²", "", None, "cat the\x00dog 12a", "Σ ΣΑΣ İx cat", "\u0301 -- the"]
    rows = [(i, texts[i % 7], None if i % 5 == 4 else i % 2, i % 3) for i in range(70)]
    df = spark.createDataFrame(rows, "id bigint, text string, y int, fold int")
    tables, settle = [], scorers.settle
    monkeypatch.setattr(scorers, "settle", lambda table: tables.append(table) or settle(table))
    for piece in (1, 1 << 20):
        monkeypatch.setattr(scorers, "PIECE_BYTES", piece)
        few = scorers.naive_bayes_scores(df, "id", "text", "y", "fold", 2, 3, broadcast_bytes=1500)
        all_known = scorers.naive_bayes_scores(df, "id", "text", "y", "fold", 2, 3, broadcast_bytes=1 << 30)
        got, want = ({r.id: r.probs for r in d.collect()} for d in (few, all_known))
        assert len(got) == 70 and got == {i: pytest.approx(p, rel=1e-9) for i, p in want.items()}
    # the tokens of each text were grouped by text and token, with a shuffle of all pairs
    assert len(tables) == 2
    for table in tables:
        assert "Exchange" not in table._jdf.queryExecution().executedPlan().toString()


def test_naive_bayes_unknown_tokens_add_alpha(spark):
    rows = [(0, "a b", 0, 0), (1, "a a c", 1, 1), (2, "b", 1, 0), (3, "a z z", None, 0), (4, None, 0, 1)]
    df = spark.createDataFrame(rows, "id bigint, text string, y int, fold int")
    # tokens: class 0 a, b; class 1 a, a, c, b; labelled texts 2 and 2; z is in none
    odds = (1.5 / 3.5) * (0.5 / 3.5) ** 2, (2.5 / 5.5) * (0.5 / 5.5) ** 2
    for limit in (1 << 30, 600, 0):
        got = scorers.naive_bayes_scores(df, "id", "text", "y", "fold", 2, 2, alpha=0.5, broadcast_bytes=limit)
        probs = {r.id: r.probs for r in got.collect()}
        assert len(probs) == 5
        assert probs[3] == pytest.approx([o / sum(odds) for o in odds], rel=1e-9)


@pytest.mark.parametrize("kind", ["logistic", "forest", "mlp", "boosting"])
def test_ml_scorers(spark, kind, tmp_path):
    _, df = points(spark)
    df = df.withColumn("features", array_to_vector("x")).withColumn("fold", F.col("fold") % 2)
    got = scorers.ml_oof_scores(df, kind, 2, 3, n_features=6)
    got = got.withColumn("y_hat", argmax_class(F.col("probs"), 3)).cache()
    assert got.count() == 240
    total = got.select(F.aggregate("probs", F.lit(0.0), lambda a, b: a + b).alias("s"))
    assert total.filter(F.abs(F.col("s") - 1) > 1e-6).count() == 0
    assert metrics.accuracy(got).first().accuracy > 0.8
    model = scorers.fit_scorer(df, kind, 3)
    scorers.save_scorer(model, str(tmp_path / kind))
    again = scorers.load_scorer(str(tmp_path / kind))
    a = scorers.score_with(model, df, 3)
    assert scorers.score_with(again, df, 3).exceptAll(a).count() == 0


def test_oof_score_pools_the_folds(spark):
    _, df = points(spark)
    df = df.withColumn("features", array_to_vector("x")).withColumn("fold", F.col("fold") % 2)

    def fit(train):
        model = scorers.fit_scorer(train, "logistic", 3)
        return lambda test: scorers.score_with(model, test, 3, keep=["id", "y"]).withColumn(
            "y_hat", argmax_class(F.col("probs"), 3)
        )

    score = folds.oof_score(df, 2, fit, lambda p: metrics.macro_f1(p, [0, 1, 2])).first()
    assert score.n_rows == df.filter("y is not null").count()
    assert score.macro_f1 > 0.8


def test_stack(spark):
    rows, df = points(spark)
    model = scorers.fit_centroids(df, "x", "y", "fold", 3)
    wide = df.select("id", "y", "fold")
    for name, dims in (("a", [0, 1, 2]), ("b", [3, 4, 5])):
        scores = scorers.score_centroids(df, model, "x", ["id"], "fold", [(name, 0, dims)])
        wide = wide.join(scores.select("id", F.col("probs").alias(name)), "id")
    wide = folds.assign_folds(wide.drop("fold"), 2, ["id"])
    got = scorers.stack_scores(wide, ["a", "b"], 2, 3)
    assert got.count() == len(rows)
    assert metrics.accuracy(got).first().accuracy > 0.6

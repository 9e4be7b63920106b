import pytest
from pyspark.sql import functions as F

from tallyfold.functions.scores import argmax_class, decide, gated_decide, max_prob, softmax

NAN = float("nan")


def best(spark, probs, n=None):
    df = spark.createDataFrame([(probs,)], "p array<double>")
    return df.select(argmax_class(F.col("p"), n or len(probs)).alias("c")).first().c


@pytest.mark.parametrize(
    "probs, want",
    [
        ([0.2, 0.5, 0.3], 1),
        ([0.4, 0.4, 0.2], 0),
        ([0.4, 0.4 + 1e-11, 0.2], 0),
        ([0.4, 0.4 + 1e-8, 0.2], 1),
        ([NAN, 0.1, 0.2], 2),
        ([None, 0.1, 0.05], 1),
        ([-5.0, -2.0, -2.0], 1),
        ([NAN, None, NAN], None),
    ],
)
def test_argmax(spark, probs, want):
    assert best(spark, probs) == want
    # the form for many classes gives the same
    padded = probs + [None] * 37
    assert best(spark, padded) == want


def test_max_prob_ignores_nan(spark):
    df = spark.createDataFrame([([0.1, NAN, 0.3],)], "p array<double>")
    assert df.select(max_prob(F.col("p")).alias("m")).first().m == 0.3


def test_threshold_is_inclusive_and_the_value_matters(spark):
    df = spark.createDataFrame([(0.5,), (0.4999,), (0.08,), (0.0799,), (None,)], "p double")
    at = lambda th: [r.d for r in df.select(decide(F.col("p"), th).alias("d")).collect()]
    assert at(0.5) == [1, 0, 0, 0, None]
    assert at(0.08) == [1, 1, 1, 0, None]


def test_gate(spark):
    df = spark.createDataFrame(
        [(0.5, [0.9, 0.02, 0.08]), (0.49, [0.1, 0.2, 0.7]), (0.9, [0.8, 0.1, 0.1])],
        "p double, c array<double>",
    )
    got = df.select(gated_decide(F.col("p"), F.col("c"), 0.5, 3).alias("y")).collect()
    assert [r.y for r in got] == [2, 0, 1]


def test_softmax_of_large_logits(spark):
    df = spark.createDataFrame([(-30000.0, -30001.0)], "a double, b double")
    row = df.select(F.array(*softmax([F.col("a"), F.col("b")])).alias("p")).first()
    assert sum(row.p) == pytest.approx(1.0)
    assert row.p[0] == pytest.approx(0.7310585786)

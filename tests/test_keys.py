import math
from collections import Counter

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tallyfold.operators import keys, metrics

SCHEMA = "id bigint, key string, y int, fold int"
ROWS = [
    (1, "a", 0, 0),
    (2, "a", 1, 1),
    (3, "a", 1, 2),
    (4, "b", 1, 0),  # key in one fold only
    (5, "b", 1, 0),
    (6, None, 0, 1),  # no key
    (7, "c", 0, 0),  # one class only
    (8, "c", 0, 1),
    (9, "a", None, 2),  # unlabelled: may use all labels
    (10, "z", None, 0),  # unlabelled and unknown
    (11, None, None, 1),
]


def brute(rows, classes):
    """(counts the row may use for its key, prior of the other folds) per id."""
    out = {}
    for i, key, y, fold in rows:
        others = [r for r in rows if r[2] is not None and (y is None or r[3] != fold)]
        same = Counter(r[2] for r in others if key is not None and r[1] == key)
        prior = Counter(r[2] for r in others)
        out[i] = ([same[c] for c in classes], [prior[c] for c in classes])
    return out


def first_best(counts):
    return counts.index(max(counts))


@pytest.mark.parametrize("seed", range(3))
def test_features_and_candidate_against_brute_force(spark, seed):
    rows = ROWS if seed == 0 else [
        (i, f"k{(i * 7 + seed) % 11}" if i % 3 else "hot", (i * i + seed) % 3 if i % 5 else None, i % 4)
        for i in range(200)
    ]
    classes = [0, 1] if seed == 0 else [0, 1, 2]
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows, classes)
    features = keys.exact_key_features(df, "key", "y", "fold", classes, "id", 5).collect()
    assert len(features) == len(rows)
    for r in features:
        own, prior = want[r.id]
        use = own if sum(own) else prior
        assert r.key_log_n == pytest.approx(math.log1p(sum(own)))
        assert r.key_unseen == int(sum(own) == 0)
        assert r.key_n_classes == sum(c > 0 for c in own)
        assert r.key_majority == first_best(use)
        top = use[1] if len(classes) == 2 else max(use)
        assert r.key_share == pytest.approx(top / sum(use))
    for r in keys.lookup_candidate(df, "key", "y", "fold", classes, "id", 5).collect():
        own, prior = want[r.id]
        use = own if sum(own) else prior
        assert r.y_hat == first_best(use)
        assert r.probs == pytest.approx([c / sum(use) for c in use])


def test_confusion_without_the_rows_is_the_same(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    short = keys.lookup_confusion(df, "key", "y", "fold", [0, 1], 5)
    rows = metrics.confusion(keys.lookup_candidate(df, "key", "y", "fold", [0, 1], "id", 5))
    as_set = lambda d: {(r.y, r.y_hat, r.n) for r in d.collect()}
    assert as_set(short) == as_set(rows)


def test_wide_and_long_counts_agree(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    wide = keys.fold_counts(df, "key", "y", "fold", [0, 1], 5)
    long = keys.fold_counts(df, "key", "y", "fold", [0, 1], 5, wide_columns=0)
    assert wide.columns == long.columns
    assert wide.exceptAll(long).count() == 0
    assert wide.count() == long.count()


def test_bad_fold_fails(spark):
    df = spark.createDataFrame([(1, "a", 0, 9)], SCHEMA)
    with pytest.raises(PySparkException, match="folds must be"):
        keys.fold_counts(df, "key", "y", "fold", [0, 1], 5).collect()


def test_no_leak_through_unique_keys(spark):
    """With a key of its own every row falls back to the prior, whatever its label."""
    df = spark.range(300).select(
        "id",
        F.col("id").cast("string").alias("key"),
        (F.col("id") % 3 == 0).cast("int").alias("y"),
        (F.col("id") % 5).cast("int").alias("fold"),
    )
    got = keys.exact_key_features(df, "key", "y", "fold", [0, 1], "id", 5)
    row = got.agg(F.min("key_unseen").alias("u"), F.max("key_majority").alias("m")).first()
    assert (row.u, row.m) == (1, 0)

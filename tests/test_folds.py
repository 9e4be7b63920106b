import hashlib

import pytest
from pyspark.sql import functions as F

from tallyfold.operators import folds


@pytest.mark.parametrize("portable", [True, False])
def test_equal_content_is_in_one_fold(spark, portable):
    df = spark.range(1000).withColumn("text", F.concat(F.lit("t"), F.col("id") % 90))
    got = folds.assign_folds(df, 5, ["text"], portable=portable)
    per_text = got.groupBy("text").agg(F.countDistinct("fold").alias("n"))
    assert per_text.filter("n > 1").count() == 0
    assert got.select("fold").distinct().count() == 5
    other = folds.assign_folds(df, 5, ["text"], seed="x", portable=portable)
    assert other.exceptAll(got).count() > 0


def test_several_columns_and_nulls(spark):
    df = spark.createDataFrame(
        [(1, "a", None), (2, "a", None), (3, None, "a")], "id bigint, p string, q string"
    )
    got = {r.id: r.fold for r in folds.assign_folds(df, 1000, ["p", "q"]).collect()}
    assert got[1] == got[2] != got[3]


def test_stratified_folds_are_balanced_and_grouped(spark):
    df = spark.range(2000).select(
        "id",
        F.concat(F.lit("g"), F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 700)).alias("g"),
        F.when(F.col("id") % 10 < 7, (F.col("id") % 700 < 100).cast("int")).alias("y"),
    )
    got = folds.stratified_folds(df, 5, "g", "y", "id")
    assert got.count() == 2000
    assert got.groupBy("g").agg(F.countDistinct("fold").alias("n")).filter("n > 1").count() == 0
    # groups of one class are dealt out evenly
    groups = got.groupBy("g").agg(F.max("y").alias("y"), F.min("y").alias("lo"), F.first("fold").alias("fold"))
    pure = groups.filter("y = lo and g <> 'g-1'").groupBy("y", "fold").count()
    for y in (0, 1):
        sizes = [r["count"] for r in pure.filter(F.col("y") == y).collect()]
        assert len(sizes) == 5
        assert max(sizes) - min(sizes) <= 2


def test_smoke_sample(spark):
    df = spark.range(500).withColumn("y", (F.col("id") % 7 == 0).cast("int"))
    got = folds.smoke_sample(df, 4, "y", "id")
    rows = sorted((hashlib.md5(str(i).encode()).hexdigest(), i, int(i % 7 == 0)) for i in range(500))
    want = {i for y in (0, 1) for _, i, _ in [r for r in rows if r[2] == y][:4]}
    assert {r.id for r in got.collect()} == want
    assert got.columns == df.columns


def test_oof_scores_every_row_once(spark):
    df = spark.range(100).withColumn("fold", (F.col("id") % 3).cast("int"))

    def fit(train):
        seen = {r.fold for r in train.select("fold").distinct().collect()}
        return lambda test: test.withColumn("seen", F.col("fold").isin(list(seen)))

    got = folds.oof(df, 3, fit)
    assert got.count() == 100
    assert got.filter("seen").count() == 0

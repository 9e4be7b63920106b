from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyfold.operators.skew import bucketed_rank, frequent_from, key_table, lookup_join, side_by_side


def hot_rows(spark):
    """A third of the rows has one key, some have none, some have one nobody knows."""
    key = (
        F.when(F.col("id") % 3 == 0, "hot")
        .when(F.col("id") % 10 == 1, F.lit(None))
        .when(F.col("id") % 10 == 2, "unknown")
        .otherwise(F.concat(F.lit("k"), F.col("id") % 2000))
    )
    return spark.range(9000).withColumn("key", key)


def test_lookup_join_is_whole_on_both_ways(spark):
    rows = hot_rows(spark)
    table = (
        rows.filter("key is not null and key <> 'unknown'")
        .groupBy("key")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.max("id").alias("top"))
    )
    want = rows.join(table.drop("n_rows"), "key", "left").select("id", "key", "top")
    for limit in (1 << 30, 0):
        for keys, weight in ((table, "n_rows"), (table.drop("n_rows"), None)):
            got = lookup_join(rows, keys, ["key"], ["id"], weight, broadcast_bytes=limit)
            assert got.columns == ["key", "id", "top"]
            got = got.select("id", "key", "top")
            assert got.count() == 9000
            assert got.exceptAll(want).count() == 0


def test_size_is_measured_on_the_way(spark):
    table = spark.range(100).select(
        F.repeat(F.lit("x"), 1000).alias("key"), F.col("id").alias("n_rows")
    )
    small = key_table(table)
    assert small.total == sum(range(100))
    assert 200_000 <= small.size <= 250_000
    assert small.is_small(1 << 20) and not small.is_small(1 << 17)
    nested = table.withColumn("a", F.array(F.lit(1)))
    assert not key_table(nested).is_small(1 << 40)


def test_hot_key_is_split(spark):
    """No task of the shuffled join gets the whole hot key."""
    rows = hot_rows(spark)
    table = rows.filter("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("n_rows"))
    table = table.withColumn("v", F.lit(1))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = lookup_join(rows, table, ["key"], ["id"], broadcast_bytes=0)
        spread = joined.filter("key = 'hot'").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(r["count"] for r in spread) == 3000
    assert max(r["count"] for r in spread) < 1500


def test_side_by_side_collapses_repeats(spark):
    a = spark.createDataFrame([(1, 5)] * 1000 + [(2, 6)], "id bigint, v int")
    b = spark.createDataFrame([(1, 7)] * 1000 + [(3, 8)], "id bigint, w int")
    rows = side_by_side(a, b, ["id"], {"v": F.col("v")}, {"w": F.col("w")}).collect()
    got = {r.id: (r.n_a, r.n_b, r.v, r.w) for r in rows}
    assert got == {1: (1000, 1000, 5, 7), 2: (1, 0, 6, None), 3: (0, 1, None, 8)}


def test_bucketed_rank_equals_row_number(spark):
    df = spark.range(5000).select(
        "id",
        F.when(F.col("id") % 3 == 0, "a").otherwise(F.concat(F.lit("g"), F.col("id") % 4)).alias("g"),
        F.md5(F.col("id").cast("string")).alias("m"),
    )
    got = bucketed_rank(df, ["g"], [F.substring("m", 1, 2)], [F.col("m")])
    w = Window.partitionBy("g").orderBy("m")
    want = df.withColumn("rank", F.row_number().over(w))
    assert got.select("id", "rank").exceptAll(want.select("id", "rank")).count() == 0
    assert got.count() == 5000


def test_frequent_keys_fit_the_limit(spark):
    rows = [(f"k{i}", 1000 if i < 3 else 10 if i < 8 else 1) for i in range(50)]
    keys = key_table(spark.createDataFrame(rows, "key string, n_rows bigint"))
    each = 16 * 2 + 64 + 2 * 2
    assert frequent_from(keys, 3 * each - 1) is None
    assert frequent_from(keys, 3 * each) == 1000
    assert frequent_from(keys, 8 * each) == 10
    assert frequent_from(keys, 60 * each) == 1

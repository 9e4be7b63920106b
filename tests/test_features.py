import hashlib
import math
from collections import Counter

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tallyfold.operators import byte_features, ensemble, log_features, tabular, text_features


def bits(seq):
    n = Counter(seq)
    total = sum(n.values())
    return -sum(c / total * math.log2(c / total) for c in n.values()) if total else 0.0


def test_text_counts(spark):
    text = "Get http://a.b/c?x=1 and https://d 'AAAABBBBCCCCDDDDEEEEFFFF==' é!"
    row = text_features.text_counts(spark.createDataFrame([(text,)], "text string")).first()
    assert row.n_length == len(text)
    assert row.n_urls == 2
    assert row.n_base64 == 1
    symbols = [c for c in text if not c.isalnum() and c not in " \t\r\n"]
    assert row.n_symbols == len(symbols)
    assert row.symbol_ratio == pytest.approx(len(symbols) / len(text))


def test_entropy(spark):
    texts = ["aabb", "abcdé", "a" * 5000, "x\ny z"]
    df = spark.createDataFrame(list(enumerate([*texts, ""])), "id bigint, text string")
    got = {r.id: r for r in text_features.char_entropy(df, "id").collect()}
    assert sorted(got) == [0, 1, 2, 3]
    for i, t in enumerate(texts):
        assert got[i].entropy == pytest.approx(bits(t), abs=1e-12)
        assert (got[i].n_chars, got[i].n_distinct) == (len(t), len(set(t)))


def test_windows_cover_the_text(spark):
    texts = ["abcdefghij", "abcdefghi", "a", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    rows = text_features.windows(df, ["id"], n=3).collect()
    got = {}
    for r in rows:
        got.setdefault(r.id, []).append((r.view, r.view_text))
    views = {i: [t for _, t in sorted(v)] for i, v in got.items()}
    assert views == {
        0: ["abcde", "cdefg", "fghij"],
        1: ["abcde", "cdefg", "efghi"],
        2: ["a", "a", "a"],
        3: ["", "", ""],
    }
    scored = spark.createDataFrame([(1, 0.2), (1, 0.4), (1, 0.9)], "id bigint, p double")
    row = ensemble.mean_over_views(scored, ["id"], ["p"]).first()
    assert (row.n_views, row.p) == (3, pytest.approx(0.5))


def test_hashed_tokens(spark):
    df = spark.createDataFrame([("b a b",)], "text string")
    vector = text_features.hashed_tokens(df, dims=64).first().features
    assert vector.size == 64 and sum(vector.values) == 3


def test_byte_features(spark, tmp_path):
    blobs = {
        "zero": b"",
        "flat": bytes(1000),
        "all": bytes(range(256)) * 3,
        "long": bytes((i * i) % 251 for i in range(byte_features.BLOCK + 777)),
    }
    df = spark.createDataFrame(list(blobs.items()), "path string, content binary")
    for r in byte_features.byte_features(df).collect():
        data = blobs[r.path]
        assert r.size == len(data)
        assert r.sha256 == hashlib.sha256(data).hexdigest()
        assert r.histogram == [Counter(data)[b] for b in range(256)]
        assert r.entropy == pytest.approx(bits(data), abs=1e-9)
        parts = [bits(data[i : i + 256]) for i in range(0, len(data), 256)] or [0.0]
        assert r.max_window_entropy == pytest.approx(max(parts), abs=1e-9)
        assert r.mean_window_entropy == pytest.approx(sum(parts) / len(parts), abs=1e-9)


def test_zscore(spark):
    df = spark.createDataFrame(
        [(1, "a", 1.0), (2, "a", 3.0), (3, "b", 5.0), (4, "c", 2.0), (5, "c", 2.0)],
        "id bigint, g string, v double",
    )
    got = {r.id: r.z for r in log_features.zscore(df, "v", "g", "id").collect()}
    assert got[1] == pytest.approx(-1 / math.sqrt(2)) and got[2] == pytest.approx(1 / math.sqrt(2))
    assert got[3] is None and got[4] is None


def test_rare_template(spark):
    rows = [(i, "e", f"user {i} ok") for i in range(10, 29)] + [(99, "e", "disk failed")]
    df = spark.createDataFrame(rows, "id bigint, e string, m string")
    got = log_features.rare_template(df, F.col("m"), 0.05, ["e"], "id").collect()
    rare = [r for r in got if r.is_rare]
    assert [(r.id, r.template, r.template_n) for r in rare] == [(99, "disk failed", 1)]
    assert next(r for r in got if r.id == 10).template == "user ## ok"
    with pytest.raises(ValueError):
        log_features.rare_template(df, F.col("m"), 0.05, [], "id")


def test_log_counts(spark):
    df = spark.sql(
        "select * from values (1, timestamp_ntz'2024-01-01 00:10:00'),"
        "(1, timestamp_ntz'2024-01-01 00:50:00'), (2, timestamp_ntz'2024-01-01 01:00:00') as t(u, ts)"
    )
    got = {(r.u, r.bucket.hour): r.n for r in log_features.log_counts(df, "u").collect()}
    assert got == {(1, 0): 2, (2, 1): 1}


def test_tabular_hashes_the_columns_it_is_told_to(spark):
    df = spark.range(100).select(
        (F.col("id") * 1.0).alias("x"),
        F.concat(F.lit("c"), F.col("id") % 3).alias("small"),
        F.concat(F.lit("d"), F.col("id")).alias("large"),
    )
    made = tabular.tabular_vector(df, ["x"], ["small"], ["large"])
    size = made.select(F.size(vector_to_array("features")).alias("n")).first().n
    assert size == 1 + 3 + (1 << 12)

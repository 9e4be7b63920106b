import pytest
from pyspark.sql import types as T

from tallyfold.operators import align


def frames(spark):
    teacher = spark.createDataFrame(
        [(1, 1.0, 2.0, 3.0), (2, 1.5, 2.5, None), (3, 0.0, 0.0, 0.0)],
        "id bigint, f1 double, f2 double, f3 double",
    )
    student = spark.createDataFrame(
        [(1, 1.0, 2, 3.0), (2, 1.9, 2, 3.0), (4, 0.0, 0, 0.0)],
        "id bigint, f1 double, f2 int, f3 double",
    ).withColumnRenamed("f3", "f4")
    return teacher, student


def test_compare(spark):
    teacher, student = frames(spark)
    got = {r.column: r for r in align.compare_features(teacher, student, "id").collect()}
    assert {c: r.status for c, r in got.items()} == {
        "f1": "same", "f2": "type", "f3": "only_a", "f4": "only_b",
    }
    assert (got["f1"].n_rows, got["f1"].n_mismatch) == (2, 1)
    assert got["f1"].max_abs_diff == pytest.approx(0.4)
    assert got["f2"].mismatch_rate == 0.5
    assert got["f3"].n_mismatch is None


def test_null_against_value_is_a_mismatch(spark):
    a = spark.createDataFrame([(1, None), (2, None)], "id bigint, f double")
    b = spark.createDataFrame([(1, 1.0), (2, None)], "id bigint, f double")
    assert align.compare_features(a, b, "id").first().n_mismatch == 1


def test_align_and_require(spark):
    teacher, student = frames(spark)
    made = align.align(student, teacher.schema, fill=-1.0)
    assert align.require_schema(made, teacher.schema) is made
    assert [tuple(r) for r in made.orderBy("id").collect()][0] == (1, 1.0, 2.0, -1.0)
    with pytest.raises(ValueError, match="schema differs"):
        align.require_schema(student, teacher.schema)


def test_unreadable_numbers_are_filled(spark):
    df = spark.createDataFrame([("7",), ("x",), (None,)], "f string")
    schema = T.StructType([T.StructField("f", T.DoubleType())])
    assert [r.f for r in align.align(df, schema).collect()] == [7.0, 0.0, 0.0]


def test_schema_diff(spark):
    teacher, student = frames(spark)
    got = {r.column: r for r in align.schema_diff(teacher, student).collect()}
    assert got["f2"].status == "type" and got["f2"].type_b == "int"
    assert (got["f3"].values_a, got["f3"].values_b) == (2, None)
    assert got["f4"].status == "only_b"

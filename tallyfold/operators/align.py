"""Feature tables of two origins: bring to one schema, or say where they differ."""

from __future__ import annotations


import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StructType

from tallyfold.operators.skew import side_by_side
from tallyfold.sources.shared import small_table


def align(df: DataFrame, schema: StructType, fill: float = 0.0) -> DataFrame:
    """``df`` in the columns, order and types of ``schema``.

    Missing columns and null or unreadable numbers become ``fill``; columns the
    schema does not have are dropped.
    """
    have = set(df.columns)

    def one(field) -> Column:
        numeric = isinstance(field.dataType, NumericType)
        empty = F.lit(fill if numeric else None).cast(field.dataType)
        if field.name not in have:
            return empty.alias(field.name)
        value = F.col(field.name).try_cast(field.dataType)
        return (F.coalesce(value, empty) if numeric else value).alias(field.name)

    return df.select(*[one(f) for f in schema.fields])


def require_schema(df: DataFrame, schema: StructType) -> DataFrame:
    """``df`` itself, or an error before any scoring when its columns are not those."""
    have = [(f.name, f.dataType) for f in df.schema.fields]
    want = [(f.name, f.dataType) for f in schema.fields]
    if have != want:
        raise ValueError(f"feature schema differs: have {have}, want {want}")
    return df


def _status(a: str | None, b: str | None) -> str:
    if a is None:
        return "only_b"
    if b is None:
        return "only_a"
    return "same" if a == b else "type"


def schema_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(column, type_a, type_b, status, values_a, values_b) for every column of either.

    The values are the non-null counts, so that one sees how much data a missing or
    retyped column affects.
    """
    types_a, types_b = dict(a.dtypes), dict(b.dtypes)
    names = [*types_a, *[c for c in types_b if c not in types_a]]

    def counts(df: DataFrame, types: dict, name: str) -> DataFrame:
        wide = df.agg(*[F.count(c).alias(c) for c in types])
        return wide.unpivot([], list(types), "column", name)

    facts = small_table(
        a.sparkSession,
        [
            (c, types_a.get(c), types_b.get(c), _status(types_a.get(c), types_b.get(c)))
            for c in names
        ],
        {c: pa.string() for c in ("column", "type_a", "type_b", "status")},
    )
    # one row per column on each side
    return (
        facts.join(F.broadcast(counts(a, types_a, "values_a")), "column", "left")
        .join(F.broadcast(counts(b, types_b, "values_b")), "column", "left")
    )


def compare_features(
    teacher: DataFrame, student: DataFrame, on: str, tol: float = 1e-9
) -> DataFrame:
    """(column, status, n_rows, n_mismatch, mismatch_rate, max_abs_diff) per feature.

    Status is only_a, only_b, type, or same. Columns of one type are compared in it:
    fractions within ``tol``, anything else exactly (equal longs stay equal, texts are
    compared as texts). After a type change both sides are compared as numbers where both
    can be read as such; a value that can't be differs from one that can. Rows are matched
    on the id; ids that only one side has are not counted. Columns of nested types are
    compared by their JSON. One wide grouped pass, no row per (id, column).
    """
    types_t = {c: t for c, t in teacher.dtypes if c != on}
    types_s = {c: t for c, t in student.dtypes if c != on}
    names = [*types_t, *[c for c in types_s if c not in types_t]]
    shared = [c for c in names if c in types_t and c in types_s]
    retyped = {c for c in shared if types_t[c] != types_s[c]}

    def value(c: str, kind: str) -> Column:
        if kind.startswith(("array", "map", "struct")):
            return F.to_json(F.struct(F.col(c).alias("v")))
        return F.col(c).try_cast("double") if c in retyped else F.col(c)

    pairs = side_by_side(
        teacher,
        student,
        [on],
        {f"t_{c}": value(c, types_t[c]) for c in shared},
        {f"s_{c}": value(c, types_s[c]) for c in shared},
        unique=True,
    ).filter((F.col("n_a") > 0) & (F.col("n_b") > 0))

    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for i, c in enumerate(shared):
        t, s = F.col(f"t_{c}"), F.col(f"s_{c}")
        kind = types_t[c]
        number = kind.startswith(("decimal", "tinyint", "smallint", "int", "bigint"))
        fraction = c in retyped or kind in ("double", "float")
        gap = F.abs(t.cast("double") - s.cast("double")) if number or fraction else F.lit(None).cast("double")
        if fraction:
            differs = F.coalesce(gap > tol, t.isNull() != s.isNull())
        else:
            differs = ~t.eqNullSafe(s)
        aggs.append(F.sum(differs.cast("bigint")).alias(f"m{i}"))
        aggs.append(F.max(gap).alias(f"d{i}"))
    null = F.lit(None)
    entries = [
        F.struct(
            F.lit(c).alias("column"),
            F.lit(_status(types_t.get(c), types_s.get(c))).alias("status"),
            F.col("n_rows"),
            (F.col(f"m{shared.index(c)}") if c in shared else null)
            .cast("bigint")
            .alias("n_mismatch"),
            (F.col(f"d{shared.index(c)}") if c in shared else null)
            .cast("double")
            .alias("max_abs_diff"),
        )
        for c in names
    ]
    per_column = pairs.agg(*aggs).select(F.inline(F.array(*entries)))
    return per_column.withColumn(
        "mismatch_rate",
        F.when(F.col("n_rows") > 0, F.col("n_mismatch") / F.col("n_rows")),
    )

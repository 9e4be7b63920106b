"""Run the queries and their SQL on the same tables and compare.

    python tests/compare.py [folder] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

SAME_TYPE = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
}


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as from '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(value)
    return str(value)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(got, con, sql: str) -> str | None:
    """None if the DataFrame and the SQL agree, else what differs."""
    rows = rows_of(got.columns, got.collect())
    want = con.execute(sql)
    columns = [d[0] for d in want.description]
    kinds = {d[0]: str(d[1]) for d in want.description}
    expected = rows_of(columns, want.fetchall())
    if sorted(columns) != sorted(got.columns):
        return f"columns {sorted(got.columns)} != {sorted(columns)}"
    for field in got.schema.fields:
        spark_kind, sql_kind = field.dataType.simpleString(), kinds[field.name]
        if SAME_TYPE.get(spark_kind) != sql_kind:
            return f"{field.name}: {spark_kind} in Spark, {sql_kind} in SQL"
    if not rows:
        return "no rows to compare"
    if len(rows) != len(expected):
        return f"{len(rows)} rows != {len(expected)}"
    bad = [(a, b) for a, b in zip(rows, expected) if a != b]
    if bad:
        return f"{len(bad)} of {len(rows)} rows differ: {bad[:3]}"
    return None


def main() -> None:
    from tests.session import session

    from __spark_entry__ import oracle_sql, queries

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = session()
    con, sqls, failed = duck(sf_dir), oracle_sql(), 0
    for name, query in queries().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        start = time.time()
        try:
            got = query(spark, sf_dir)
            if name in sqls:
                result = compare(got, con, sqls[name])
            else:
                result, n = None, len(got.collect())
                print(f"     {name}: {n} rows only")
        except Exception as error:  # noqa: BLE001
            result = f"{type(error).__name__}: {str(error)[:600]}"
        failed += result is not None
        print(f"{'ok  ' if result is None else 'FAIL'} {name} {time.time() - start:.1f}s", result or "")
    print("failed:", failed)


if __name__ == "__main__":
    main()

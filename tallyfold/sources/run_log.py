"""Run logs as text.

Four layouts are read: ``- 2024-01-31：text``, ``[2024-01-31 10:20:30] text``,
``- 2024-01-31 10:20:30 text`` and the table row ``| project | text | .. |``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The patterns of the layouts.
STAMP = r"^(?:- |\[)([0-9]{4}-[0-9]{2}-[0-9]{2})( [0-9]{2}:[0-9]{2}:[0-9]{2})?(?:\]|：|:)? ?"
NAME = r"\b(v[0-9]+\.[0-9]+(?:_[A-Za-z][A-Za-z0-9]*)?|original)\b"
SELECTED = r"\bselected=([A-Za-z0-9_]+)"
METRIC = r"([A-Za-z][A-Za-z0-9_-]*)=([+-]?[0-9]+(?:\.[0-9]+)?)"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "line")


def _found(value: Column) -> Column:
    return F.nullif(F.trim(value), F.lit(""))


def parse_run_log(lines: DataFrame, line: str = "line") -> DataFrame:
    """Add ts, project, version, selected and metrics (map of name to number).

    project is what stands before the first version: the first cell of a table row,
    else the text after the time. Of a metric named twice the last value counts. A
    line with no time, version or metric gives nulls and an empty map. So do a table's
    rule (``|---|---|``) and its head, which names no version, number or time.
    """
    text = F.col(line)
    steps = lines.select(
        "*",
        F.regexp_extract(text, STAMP, 0).alias("_stamp"),
        F.regexp_extract_all(text, F.lit(METRIC), F.lit(1)).alias("_names"),
        F.regexp_extract_all(text, F.lit(METRIC), F.lit(2)).alias("_values"),
    )
    row = text.startswith("|")
    body = F.substr(text, F.when(row, F.lit(2)).otherwise(F.length("_stamp") + 1))
    steps = steps.withColumn("_body", body).withColumn(
        "_version", F.regexp_extract("_body", NAME, 1)
    )
    day = F.regexp_extract("_stamp", r"[0-9]{4}-[0-9]{2}-[0-9]{2}", 0)
    clock = F.regexp_extract("_stamp", r" [0-9]{2}:[0-9]{2}:[0-9]{2}", 0)
    stamp = F.concat(day, F.when(clock == "", " 00:00:00").otherwise(clock))
    before = F.substr(
        F.col("_body"), F.lit(1), F.regexp_instr("_body", F.lit(NAME)) - 1
    )
    # a row without a version or a number is a table's head or rule
    says = (F.col("_version") != "") | (F.size("_names") > 0)
    head = F.when(row & says, F.split_part("_body", F.lit("|"), F.lit(1))).when(
        ~row & (F.col("_version") != ""), before
    )
    names, values = F.col("_names"), F.col("_values")
    numbers = values.cast("array<double>")
    last = F.filter(
        F.arrays_zip(names.alias("k"), numbers.alias("v")),
        lambda p, i: ~F.array_contains(F.slice(names, i + 2, F.size(names)), p["k"]),
    )
    metrics = F.when(
        F.size(F.array_distinct(names)) == F.size(names), F.map_from_arrays(names, numbers)
    ).otherwise(F.map_from_entries(last))
    return steps.select(
        *lines.columns,
        stamp.try_cast("timestamp_ntz").alias("ts"),
        _found(head).alias("project"),
        _found(F.col("_version")).alias("version"),
        _found(F.regexp_extract(text, SELECTED, 1)).alias("selected"),
        metrics.alias("metrics"),
    )

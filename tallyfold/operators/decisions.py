"""Thresholds, pseudo-labels and confidence bands."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.functions.scores import argmax_class, max_prob, quantise, quantised
from tallyfold.sources.shared import small_table


def _steps_reached(p: Column, edges: Sequence[float]) -> Column:
    """How many of the ascending edges the score has reached."""
    q = quantise(p)
    reached = [(q >= F.lit(quantised(e))).cast("int") for e in edges]
    return F.coalesce(sum(reached[1:], reached[0]), F.lit(0))


def threshold_sweep(
    df: DataFrame, grid: Sequence[float], p: str = "p", y: str = "y"
) -> DataFrame:
    """(threshold, tp, fp, fn, tn, precision, recall, f1, accuracy, best) per threshold.

    Each row is counted once, in the bin between two thresholds; sums from the top
    bin down give every threshold's counts. Null scores are below every threshold.
    The best threshold has the highest f1, the smallest one on ties.
    """
    grid = sorted(set(grid))
    zero = F.lit(0).cast("bigint")
    bins = (
        df.filter(F.col(y).isNotNull())
        .groupBy(_steps_reached(F.col(p), grid).alias("bin"))
        .agg(
            F.sum((F.col(y) == 1).cast("bigint")).alias("pos"),
            F.sum((F.col(y) != 1).cast("bigint")).alias("neg"),
        )
    )
    listed = small_table(
        df.sparkSession,
        [(0, None), *[(i + 1, float(t)) for i, t in enumerate(grid)]],
        {"bin": pa.int32(), "threshold": pa.float64()},
    )
    # one row per threshold from here on
    table = (
        bins.withColumn("threshold", F.lit(None).cast("double"))
        .unionByName(listed.select("bin", zero.alias("pos"), zero.alias("neg"), "threshold"))
        .groupBy("bin")
        .agg(
            F.sum("pos").alias("pos"),
            F.sum("neg").alias("neg"),
            F.max("threshold").alias("threshold"),
        )
    )
    down = Window.orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy(F.lit(0))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    swept = (
        table.withColumn("tp", F.sum("pos").over(down))
        .withColumn("fp", F.sum("neg").over(down))
        .withColumn("fn", F.sum("pos").over(everything) - tp)
        .withColumn("tn", F.sum("neg").over(everything) - fp)
        .filter(F.col("threshold").isNotNull())
        .withColumn("precision", F.try_divide(tp, tp + fp))
        .withColumn("recall", F.try_divide(tp, tp + fn))
        .withColumn("f1", F.coalesce(F.try_divide(2.0 * tp, 2 * tp + fp + fn), F.lit(0.0)))
        .withColumn("accuracy", F.try_divide(tp + tn, tp + fp + fn + tn))
    )
    order = Window.orderBy(quantise(F.col("f1")).desc(), "threshold")
    return swept.withColumn("best", F.row_number().over(order) == 1).drop(
        "bin", "pos", "neg"
    )


def with_confidence(scores: DataFrame, n_classes: int) -> DataFrame:
    """Add ``confidence`` (highest probability) and ``y_hat``."""
    return scores.withColumn("confidence", max_prob(F.col("probs"))).withColumn(
        "y_hat", argmax_class(F.col("probs"), n_classes)
    )


def pseudo_label(
    scores: DataFrame,
    threshold: float,
    n_classes: int,
    per_class_cap: int | None = None,
    id_col: str = "id",
) -> DataFrame:
    """(id, y_hat, confidence) of the rows sure enough to be used as labels.

    ``per_class_cap`` keeps the surest rows of each class: by confidence in whole
    thousandths, then by md5 of the id. Each thousandth of a class is counted in 65,536
    parts; only parts that hold the first rows are ranked, each for itself.
    """
    sure = with_confidence(scores, n_classes).filter(
        quantise(F.col("confidence")) >= F.lit(quantised(threshold))
    )
    picked = sure.select(id_col, "y_hat", "confidence")
    if per_class_cap is None:
        return picked
    keyed = picked.withColumn(
        "_step", -F.floor(quantise(F.col("confidence")) / 1_000_000)
    ).withColumn("_m", F.md5(F.col(id_col).cast("string")))
    cut = keyed.withColumn("_part", F.coalesce(F.substring("_m", 1, 4), F.lit("")))
    before = (
        Window.partitionBy("y_hat")
        .orderBy("_step", "_part")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    # every part has a row, so at most per_class_cap parts of a class hold the first rows
    parts = (
        cut.groupBy("y_hat", "_step", "_part")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .filter(F.col("_before") < per_class_cap)
        .drop("_n")
    )
    inside = Window.partitionBy("y_hat", "_step", "_part").orderBy("_m", id_col)
    return (
        cut.join(parts, ["y_hat", "_step", "_part"])
        .withColumn("_rank", F.row_number().over(inside) + F.col("_before"))
        .filter(F.col("_rank") <= per_class_cap)
        .select(id_col, "y_hat", "confidence")
    )


def pseudo_coverage(
    scores: DataFrame, thresholds: Sequence[float], n_classes: int
) -> DataFrame:
    """(threshold, pool, selected, coverage) for each threshold, in one pass."""
    top = quantise(max_prob(F.col("probs")))
    counts = scores.agg(
        F.count(F.lit(1)).alias("pool"),
        *[
            F.coalesce(F.sum((top >= F.lit(quantised(t))).cast("bigint")), F.lit(0)).alias(
                f"s{i}"
            )
            for i, t in enumerate(thresholds)
        ],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(float(t)).alias("threshold"),
                F.col("pool"),
                F.col(f"s{i}").alias("selected"),
            )
            for i, t in enumerate(thresholds)
        ]
    )
    return counts.select(F.inline(rows)).withColumn(
        "coverage", F.try_divide(F.col("selected"), F.col("pool"))
    )


def confidence_bands(
    oof: DataFrame, edges: Sequence[float], n_classes: int, y: str = "y"
) -> DataFrame:
    """(band, lower, n, n_right, precision) of labelled rows by top probability.

    Band 0 is below the first edge. Report it with the coverage: a low band adds rows
    and noise.
    """
    edges = sorted(edges)
    scored = with_confidence(oof, n_classes).filter(F.col(y).isNotNull())
    band = _steps_reached(F.col("confidence"), edges)
    lower = F.get(F.array(*[F.lit(float(e)) for e in [0.0, *edges]]), F.col("band"))
    return (
        scored.groupBy(band.alias("band"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.col(y).eqNullSafe(F.col("y_hat")).cast("bigint")).alias("n_right"),
        )
        .withColumn("lower", lower)
        .withColumn("precision", F.col("n_right") / F.col("n"))
        .select("band", "lower", "n", "n_right", "precision")
    )


def with_pseudo(
    labelled: DataFrame, pseudo: DataFrame, weight: float, id_col: str = "id"
) -> DataFrame:
    """(id, y, weight, is_pseudo): true labels with weight 1, pseudo-labels with
    ``weight``. An id with a true label keeps it. Both tables have one row per id."""
    true = labelled.select(id_col, F.col("y"))
    extra = pseudo.join(true.select(id_col), id_col, "left_anti").select(
        id_col, F.col("y_hat").alias("y")
    )
    return true.withColumn("weight", F.lit(1.0)).withColumn("is_pseudo", F.lit(0)).unionByName(
        extra.withColumn("weight", F.lit(float(weight))).withColumn("is_pseudo", F.lit(1))
    )

"""Confusion counts and the scores made from them.

Every metric starts from one grouped count of (true, predicted) pairs, so only
that small table is shuffled. Rows without a true class are left out; a missing
prediction counts as wrong.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.operators.skew import side_by_side


def confusion(
    pred: DataFrame, y: str = "y", y_hat: str = "y_hat", by: Sequence[str] = ()
) -> DataFrame:
    """(by, y, y_hat, n)."""
    return (
        pred.filter(F.col(y).isNotNull())
        .groupBy(*by, F.col(y).alias("y"), F.col(y_hat).alias("y_hat"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _class_cells(conf: DataFrame, classes: Sequence | None, by: Sequence[str]) -> DataFrame:
    """(by, class, tp, n_true, n_pred): two rows per confusion cell."""
    zero = F.lit(0).cast("bigint")
    n = F.col("n")
    hit = F.when(F.col("y") == F.col("y_hat"), n).otherwise(zero)
    sides = F.array(
        F.struct(
            F.col("y").alias("class"),
            hit.alias("tp"),
            n.alias("n_true"),
            zero.alias("n_pred"),
        ),
        F.struct(
            F.col("y_hat").alias("class"),
            zero.alias("tp"),
            zero.alias("n_true"),
            n.alias("n_pred"),
        ),
    )
    cells = conf.select(*by, F.inline(sides)).filter(F.col("class").isNotNull())
    return cells if classes is None else cells.filter(F.col("class").isin(list(classes)))


def _f1_of_cells(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    return with_f1(
        cells.groupBy(*by, "class").agg(
            *[F.sum(c).alias(c) for c in ("tp", "n_true", "n_pred")]
        )
    )


def class_f1(conf: DataFrame, classes: Sequence | None = None) -> DataFrame:
    """(class, tp, n_true, n_pred, f1) from a confusion table.

    With a class list, classes outside it are dropped and listed ones that never
    occur get a zero row.
    """
    cells = _class_cells(conf, classes, ())
    if classes is not None:
        zero = F.lit(0).cast("bigint")
        listed = conf.sparkSession.range(1).select(
            F.explode(F.array(*[F.lit(c) for c in classes])).alias("class"),
            *[zero.alias(c) for c in ("tp", "n_true", "n_pred")],
        )
        cells = cells.unionByName(listed)
    return _f1_of_cells(cells, ())


def with_f1(per_class: DataFrame) -> DataFrame:
    """Add f1 = 2 tp / (n_true + n_pred), 0 where both are 0."""
    both = F.col("n_true") + F.col("n_pred")
    return per_class.withColumn(
        "f1", F.when(both > 0, 2.0 * F.col("tp") / both).otherwise(F.lit(0.0))
    )


def macro_f1_of(
    conf: DataFrame, classes: Sequence | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """(by, n_rows, n_classes, macro_f1) from a confusion table.

    Closed scope: mean over the listed classes, absent ones count as 0. Open scope
    (no list): mean over the classes seen as true or predicted.
    """
    f1 = _f1_of_cells(_class_cells(conf, classes, by), by)
    seen = F.count(F.lit(1))
    size = seen if classes is None else F.lit(len(classes)).cast("bigint")
    return f1.groupBy(*by).agg(
        F.coalesce(F.sum("n_true"), F.lit(0)).alias("n_rows"),
        size.alias("n_classes"),
        F.coalesce(F.sum("f1") / size, F.lit(0.0)).alias("macro_f1"),
    )


def macro_f1(
    pred: DataFrame,
    classes: Sequence | None = None,
    by: Sequence[str] = (),
    y: str = "y",
    y_hat: str = "y_hat",
) -> DataFrame:
    return macro_f1_of(confusion(pred, y, y_hat, by), classes, by)


def macro_f1_positive(
    pred: DataFrame, negative=0, classes: Sequence | None = None
) -> DataFrame:
    """Macro-F1 over the truly positive rows only. An optimistic scope: false alarms
    on negative rows are not seen."""
    positive = pred.filter(F.col("y") != F.lit(negative))
    inside = None if classes is None else [c for c in classes if c != negative]
    return macro_f1(positive, inside)


def accuracy(pred: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, n_rows, accuracy)."""
    hit = F.col("y").eqNullSafe(F.col("y_hat"))
    return (
        pred.filter(F.col("y").isNotNull())
        .groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.avg(hit.cast("double")).alias("accuracy"),
        )
    )


def weighted_f1(pred: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """F1 weighted by the true count of each class."""
    f1 = _f1_of_cells(_class_cells(confusion(pred, by=by), None, by), by)
    return f1.groupBy(*by).agg(
        F.sum("n_true").alias("n_rows"),
        (F.sum(F.col("f1") * F.col("n_true")) / F.sum("n_true")).alias("weighted_f1"),
    )


def metric_by_seed(
    pred: DataFrame, classes: Sequence | None = None, seed: str = "seed"
) -> DataFrame:
    """Mean and spread of macro-F1 over seeds: one row."""
    per_seed = macro_f1(pred, classes, by=[seed])
    return per_seed.agg(
        F.count(F.lit(1)).alias("n_seeds"),
        F.avg("macro_f1").alias("mean_macro_f1"),
        F.stddev_samp("macro_f1").alias("std_macro_f1"),
        F.min("macro_f1").alias("min_macro_f1"),
        F.max("macro_f1").alias("max_macro_f1"),
    )


def class_delta(a: DataFrame, b: DataFrame, y_hat: str = "y_hat") -> DataFrame:
    """(class, n_a, n_b, delta): predicted rows per class, old and new."""
    counts = a.select(F.col(y_hat).alias("class"), F.lit(1).alias("a"), F.lit(0).alias("b"))
    counts = counts.unionByName(
        b.select(F.col(y_hat).alias("class"), F.lit(0).alias("a"), F.lit(1).alias("b"))
    )
    return counts.groupBy("class").agg(
        F.sum("a").alias("n_a"),
        F.sum("b").alias("n_b"),
        (F.sum("b") - F.sum("a")).alias("delta"),
    )


def flip_matrix(
    a: DataFrame, b: DataFrame, on: str = "id", y_hat: str = "y_hat"
) -> DataFrame:
    """(old, new, n): how the ids found in both submissions changed class. Rows without an
    id are in neither; an id that one submission has twice is an error."""
    both = side_by_side(
        a, b, [on], {"old": F.col(y_hat)}, {"new": F.col(y_hat)}, unique=True
    ).filter((F.col("n_a") > 0) & (F.col("n_b") > 0))
    return both.groupBy("old", "new").agg(F.count(F.lit(1)).alias("n"))


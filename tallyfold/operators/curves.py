"""Thresholds over all scores, and calibrated scores.

Both start from one row per distinct score, counted before anything is brought in order, and
run in ranges of the scores; no task holds a class.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.functions.scores import SCORE_SCALE, quantise
from tallyfold.operators.skew import lookup_join, running_sums
from tallyfold.sources.shared import settle


def _counted(df: DataFrame, p: str, y: str, *by: str) -> DataFrame:
    """(by, q, n, pos): labelled rows by score in whole steps of 1e-9; missing scores go."""
    return (
        df.filter(F.col(y).isNotNull())
        .select(*by, quantise(F.col(p)).alias("q"), (F.col(y) == 1).cast("bigint").alias("pos"))
        .filter(F.col("q").isNotNull())
        .groupBy(*by, "q")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("pos").alias("pos"))
    )


# --- thresholds ---------------------------------------------------------------------------


def threshold_curve(df: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    """(threshold, tp, fp, fn, tn, precision, recall, f1) at every distinct score.

    Rows at the threshold and above are taken for positive; equal scores come in together.
    Rows without a score are below every threshold: they are false or true negatives.
    Without a positive row recall is null.
    """
    counted = settle(_counted(df, p, y))
    is_pos = (F.col(y) == 1).cast("bigint")
    total = df.filter(F.col(y).isNotNull()).agg(
        F.coalesce(F.sum(is_pos), F.lit(0)).alias("pos"),
        F.coalesce(F.sum(1 - is_pos), F.lit(0)).alias("neg"),
    ).first()
    summed = running_sums(
        counted, [], [F.col("q").desc()], {"tp": F.col("pos"), "fp": F.col("n") - F.col("pos")}
    )
    tp, fp, pos, neg = F.col("tp"), F.col("fp"), F.lit(total["pos"]), F.lit(total["neg"])
    return summed.select(
        (F.col("q") / SCORE_SCALE).alias("threshold"),
        "tp",
        "fp",
        (pos - tp).alias("fn"),
        (neg - fp).alias("tn"),
        F.try_divide(tp, tp + fp).alias("precision"),
        F.try_divide(tp, pos).alias("recall"),
        F.coalesce(F.try_divide(2.0 * tp, tp + fp + pos), F.lit(0.0)).alias("f1"),
        F.col("pos").alias("_pos"),
        (F.col("n") - F.col("pos")).alias("_neg"),
    )


def threshold_summary(df: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    """(n_thresholds, best_threshold, best_f1, roc_auc, average_precision): one row.

    The best threshold has the highest F1, the smallest one on ties. The area is the share of
    (positive, negative) pairs in the right order, ties counted half; missing scores are
    below all others and equal among themselves. Average precision sums precision times the
    gain in recall; positives without a score add nothing. Null without both classes.
    """
    curve = threshold_curve(df, p, y)
    # twice the pairs that a score wins: its positives against the negatives below it and,
    # half, beside it; whole numbers, as decimals because they grow with the square of the rows
    own = F.col("_pos").cast("decimal(38,0)") * (2 * F.col("tn") + F.col("_neg")).cast("decimal(20,0)")
    found = curve.agg(
        F.count(F.lit(1)).alias("n_thresholds"),
        F.max_by(
            F.struct("threshold", "f1"), F.struct(quantise(F.col("f1")), -F.col("threshold"))
        ).alias("best"),
        F.sum(own).alias("won"),
        F.sum(F.col("_pos") * F.col("precision")).alias("weighted"),
        F.max(F.struct("tp", "fp", "fn", "tn")).alias("last"),
    )
    last = F.col("last")
    pos, neg = last["tp"] + last["fn"], last["fp"] + last["tn"]
    pairs = pos.cast("double") * neg
    # rows without a score tie with one another
    tied = last["fn"].cast("double") * last["tn"]
    return found.select(
        "n_thresholds",
        F.col("best.threshold").alias("best_threshold"),
        F.col("best.f1").alias("best_f1"),
        F.try_divide(F.col("won").cast("double") + tied, 2 * pairs).alias("roc_auc"),
        F.try_divide(F.col("weighted"), pos).alias("average_precision"),
    )


# --- isotonic calibration -------------------------------------------------------------------


def pool(blocks: Iterator[tuple[int, int, int, int]]) -> list[list[int]]:
    """Pool adjacent violators: blocks (from, to, n, pos) in order become the longest blocks
    whose share of positives rises. Shares are compared as whole numbers."""
    stack: list[list[int]] = []
    for block in blocks:
        stack.append(list(block))
        while len(stack) > 1 and stack[-2][3] * stack[-1][2] >= stack[-1][3] * stack[-2][2]:
            _, to, n, pos = stack.pop()
            stack[-1][1], stack[-1][2], stack[-1][3] = to, stack[-1][2] + n, stack[-1][3] + pos
    return stack


def _pooled(blocks: DataFrame, by: Sequence[str], cut: str) -> DataFrame:
    """Pool the blocks of each (by, cut); a new block stays in the part of its first score."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in blocks.select(*by).schema.fields)
    schema = f"{kinds}, _part int, low bigint, high bigint, n bigint, pos bigint"
    names = list(by)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("low")
        made = pool(group[["low", "high", "n", "pos"]].itertuples(index=False, name=None))
        out = pd.DataFrame(made, columns=["low", "high", "n", "pos"])
        place = group["low"].searchsorted(out["low"])
        out["_part"] = group["_part"].to_numpy()[place]
        for name in names:
            out[name] = group[name].iloc[0]
        return out[[*names, "_part", "low", "high", "n", "pos"]]

    return blocks.groupBy(*names, cut).applyInPandas(run, schema)


def isotonic_blocks(
    counted: DataFrame, by: Sequence[str], parts: int | None = None
) -> DataFrame:
    """(by, low, high, n, pos): the blocks of the rising step function nearest to the labels,
    from (by, q, n, pos) with one row per score. ``by`` must not be null.

    Scores are cut into ranges, and each range pools its own. Then neighbouring ranges, whose
    last and first blocks may still violate the order, are pooled in pairs, now with the one
    before, now with the one after, until no border is violated. A range keeps its blocks, so
    a task never holds more than two ranges; those that lose all their blocks drop out.
    """
    spark = counted.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = list(by)
    ranged = counted.repartitionByRange(parts, *names, "q")
    rows = settle(
        ranged.select(
            *names,
            F.spark_partition_id().alias("_part"),
            F.col("q").alias("low"),
            F.col("q").alias("high"),
            "n",
            "pos",
        )
    )
    blocks = settle(_pooled(rows, names, "_part"))
    shift = 0
    while True:
        # one row for each range that has blocks
        order = Window.partitionBy(*names).orderBy("_part")
        ends = blocks.groupBy(*names, "_part").agg(
            F.min_by(F.struct("n", "pos"), "low").alias("first"),
            F.max_by(F.struct("n", "pos"), "low").alias("last"),
        )
        seen = ends.withColumn("_before", F.lag("last").over(order)).withColumn(
            "_number", F.row_number().over(order)
        )
        before, first = F.col("_before"), F.col("first")
        violated = before["pos"].cast("decimal(20,0)") * first["n"] >= first["pos"].cast("decimal(20,0)") * before["n"]
        seen = settle(
            seen.select(*names, "_part", "_number", F.coalesce(violated, F.lit(False)).alias("_violated"))
        )
        if not seen.filter("_violated").limit(1).count():
            return blocks.drop("_part")
        pairs = seen.select(*names, "_part", F.floor((F.col("_number") + shift) / 2).alias("_pair"))
        blocks = settle(_pooled(blocks.join(pairs, [*names, "_part"]), names, "_pair"))
        shift = 1 - shift


def calibrated_oof(
    df: DataFrame, n_folds: int, p: str = "p", y: str = "y", fold: str = "fold", id_col: str = "id",
    parts: int | None = None,
) -> DataFrame:
    """(id, fold, y, p, calibrated): each score's share of positives by the isotonic fit on
    the other folds, so that a threshold on it is a precision.

    Rows without a label or outside the folds are calibrated by all labels (fold -1). Scores
    are compared in whole steps of 1e-9. Between two blocks the lower one counts, below the
    first the first; a row without a score, or a fold that nothing else has labels for, gets
    null.
    """
    inside = F.col(y).isNotNull() & F.col(fold).between(0, n_folds - 1)
    rows = df.select(
        F.col(id_col).alias("id"),
        F.when(inside, F.col(fold)).otherwise(F.lit(-1)).cast("int").alias("fold"),
        F.col(y).alias("y"),
        F.col(p).alias("p"),
    )
    counted = _counted(rows.filter("fold >= 0"), "p", "y", "fold")
    # for each target fold, the counts of the others
    total = counted.groupBy("q").agg(
        F.sum("n").alias("n"), F.sum("pos").alias("pos"), F.collect_list(F.struct("fold", "n", "pos")).alias("own")
    )
    targets = F.explode(F.sequence(F.lit(-1), F.lit(n_folds - 1))).alias("fold")
    left = F.col("own")

    def less(field: str) -> Column:
        mine = F.filter(left, lambda o: o["fold"] == F.col("fold"))
        return F.col(field) - F.coalesce(F.get(mine, F.lit(0))[field], F.lit(0))

    others = total.select("q", "n", "pos", "own", targets).select(
        "fold", "q", less("n").alias("n"), less("pos").alias("pos")
    )
    blocks = settle(isotonic_blocks(settle(others.filter("n > 0")), ["fold"], parts))
    return _looked_up(rows, blocks, parts)


def _looked_up(rows: DataFrame, blocks: DataFrame, parts: int | None) -> DataFrame:
    """Rows with the value of the last block that starts at or below their score: blocks and
    distinct scores are brought in one order, and block starts are counted along it."""
    scores = rows.select("fold", quantise(F.col("p")).alias("q")).filter(F.col("q").isNotNull()).distinct()
    marks = blocks.select("fold", F.col("low").alias("q"), F.lit(0).alias("kind")).unionByName(
        scores.withColumn("kind", F.lit(1))
    )
    starts = (1 - F.col("kind")).cast("bigint")
    numbered = settle(running_sums(marks, ["fold"], ["q", "kind"], {"block": starts}, parts))
    value = blocks.select("fold", F.col("low").alias("q"), (F.col("pos") / F.col("n")).alias("calibrated"))
    named = numbered.filter("kind = 0").select("fold", "q", "block").join(value, ["fold", "q"])
    asked = numbered.filter("kind = 1").select("fold", "q", F.greatest("block", F.lit(1)).alias("block"))
    told = asked.join(named.select("fold", "block", "calibrated"), ["fold", "block"], "left")
    keyed = rows.withColumn("q", quantise(F.col("p")))
    return lookup_join(keyed, told.select("fold", "q", "calibrated"), ["fold", "q"], ["id"], weight=None).select(
        "id", "fold", "y", "p", "calibrated"
    )


def threshold_for(blocks: DataFrame, precision: float, by: Sequence[str] = ("fold",)) -> DataFrame:
    """(by, threshold): the least score whose block has at least that share of positives;
    groups that never reach it are left out."""
    return (
        blocks.filter(F.col("pos") >= F.lit(precision) * F.col("n"))
        .groupBy(*by)
        .agg((F.min("low") / SCORE_SCALE).alias("threshold"))
    )

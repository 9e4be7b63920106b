"""Averages and weighted mixtures of candidate scores.

Long form: one row per (id, candidate, seed, view) with ``probs``, an array indexed
by class. Wide form: one row per id with one array per candidate.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.functions.scores import SCORE_SCALE, quantise
from tallyfold.operators.metrics import macro_f1, with_f1
from tallyfold.sources.shared import settle, small_table

MAX_WEIGHTS = 20_000
MAX_MODELS = 10_000


def mean_scores(
    scores: DataFrame, by: Sequence[str], n_classes: int, probs: str = "probs"
) -> DataFrame:
    """Mean of the arrays per group, class by class, with map-side partial sums."""
    return scores.groupBy(*by).agg(
        F.array(*[F.avg(F.get(probs, F.lit(i))) for i in range(n_classes)]).alias(probs)
    )


def mean_over_seeds(scores: DataFrame, n_classes: int, id_col: str = "id") -> DataFrame:
    return mean_scores(scores, [id_col, "candidate"], n_classes)


def mean_over_views(
    scores: DataFrame, by: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """Mean of score columns over the test-time views of a sample."""
    return scores.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_views"), *[F.avg(c).alias(c) for c in columns]
    )


def oof_weights(
    pred: DataFrame, classes: Sequence | None, model: Sequence[str]
) -> DataFrame:
    """(model, weight): the out-of-fold macro-F1 of every model."""
    return macro_f1(pred, classes, by=model).select(
        *model, F.col("macro_f1").alias("weight")
    )


def weighted_ensemble(
    scores: DataFrame,
    weights: DataFrame,
    model: Sequence[str],
    n_classes: int,
    id_col: str = "id",
) -> DataFrame:
    """Sum of weight x probs over sum of weights, per id.

    ``weights`` has one row per model. Its size is checked: up to MAX_MODELS models
    are broadcast, more are joined as Spark sees fit.
    """
    small = weights.limit(MAX_MODELS + 1).count() <= MAX_MODELS
    weighted = scores.join(F.broadcast(weights) if small else weights, list(model))
    w = F.col("weight")
    return weighted.groupBy(id_col).agg(
        F.array(
            *[
                F.try_divide(F.sum(w * F.get("probs", F.lit(i))), F.sum(w))
                for i in range(n_classes)
            ]
        ).alias("probs")
    )


def wide_scores(
    scores: DataFrame,
    candidates: Sequence[str],
    id_col: str = "id",
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row per id, one array column per candidate. An id that lacks one fails, and so
    does one that has several rows of a candidate (of several seeds or views): average
    them first."""
    wide = scores.groupBy(id_col).agg(
        *[F.max(c).alias(c) for c in keep],
        *[
            F.max(F.when(F.col("candidate") == c, F.col("probs"))).alias(c)
            for c in candidates
        ],
        *[F.count_if(F.col("candidate") == c).alias(f"_n_{c}") for c in candidates],
    )
    return wide.select(
        id_col,
        *keep,
        *[
            F.when((F.col(f"_n_{c}") == 1) & F.col(c).isNotNull(), F.col(c))
            .otherwise(
                F.raise_error(
                    F.concat(
                        F.when(F.col(f"_n_{c}") > 1, "several").otherwise("no"),
                        F.lit(f" scores of candidate {c} for id "),
                        F.coalesce(F.col(id_col).cast("string"), F.lit("null")),
                    )
                ).cast("array<double>")
            )
            .alias(c)
            for c in candidates
        ],
    )


def simplex_weights(n_candidates: int, steps: int) -> list[tuple[int, ...]]:
    """All ways to deal ``steps`` equal parts to the candidates, in order."""
    if comb(steps + n_candidates - 1, n_candidates - 1) > MAX_WEIGHTS:
        raise ValueError(f"more than {MAX_WEIGHTS} weights; take fewer steps")
    if n_candidates == 1:
        return [(steps,)]
    return [
        (first, *rest)
        for first in range(steps + 1)
        for rest in simplex_weights(n_candidates - 1, steps - first)
    ]


def fuse(candidates: Sequence[str], weights: Sequence[float], n_classes: int) -> Column:
    """Mixture of the wide score arrays."""
    columns = []
    for i in range(n_classes):
        parts = [
            F.lit(float(w)) * F.get(F.col(c), F.lit(i))
            for c, w in zip(candidates, weights)
        ]
        columns.append(sum(parts[1:], parts[0]))
    return F.array(*columns)


def search_weights(
    wide: DataFrame,
    candidates: Sequence[str],
    weights: Sequence[Sequence[float]],
    n_classes: int,
    y: str = "y",
) -> DataFrame:
    """(w_index, macro_f1) of every weight over the closed classes 0 .. n_classes-1.

    A grid of weights on every row is too much to spell out as rows: each task mixes
    its batches with numpy and hands on hits and predictions per weight and class, where
    there are any; tasks without rows hand on nothing. The shuffle grows with the tasks
    that have rows, by weights x classes rows each at most, not with the rows.
    """
    grid = np.array([list(w) for w in weights], dtype="float64")
    n_weights, k = len(grid), n_classes
    rows_at_once = max(1, 2_000_000 // (n_weights * k))
    names = list(candidates)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tp = np.zeros(n_weights * k, dtype="int64")
        n_pred = np.zeros(n_weights * k, dtype="int64")
        n_true = np.zeros(k, dtype="int64")
        offset = (np.arange(n_weights) * k)[None, :]
        for batch in batches:
            if batch.empty:
                continue
            truth = batch["_y"].to_numpy(dtype="int64")
            stacks = [np.stack(batch[c].to_numpy()) for c in names]
            for lo in range(0, len(truth), rows_at_once):
                t = truth[lo : lo + rows_at_once]
                part = [s[lo : lo + rows_at_once][:, None, :] for s in stacks]
                mix = grid[None, :, 0, None] * part[0]
                for j in range(1, len(names)):
                    mix = mix + grid[None, :, j, None] * part[j]
                # argmax takes the first, so the lowest class wins ties
                steps = np.floor(mix * SCORE_SCALE + 0.5)
                best = np.nan_to_num(steps, nan=-np.inf).argmax(axis=2)
                cell = best + offset
                n_pred += np.bincount(cell.ravel(), minlength=n_weights * k)
                tp += np.bincount(cell[best == t[:, None]], minlength=n_weights * k)
                inside = t[(t >= 0) & (t < k)]
                n_true += np.bincount(inside, minlength=k)
        cell = np.arange(n_weights * k, dtype="int64")
        made = pd.DataFrame({"w_index": cell // k, "class": cell % k, "tp": tp, "n_pred": n_pred})
        # what is true doesn't depend on the weight: told once, under weight -1
        true = pd.DataFrame({"w_index": -1, "class": np.arange(k), "tp": 0, "n_pred": n_true})
        yield pd.concat([made[made["n_pred"] > 0], true[true["n_pred"] > 0]])

    labelled = wide.filter(F.col(y).isNotNull()).select(
        F.col(y).cast("bigint").alias("_y"), *names
    )
    cells = (
        labelled.mapInPandas(count, "w_index bigint, class bigint, tp bigint, n_pred bigint")
        .groupBy("w_index", "class")
        .agg(F.sum("tp").alias("tp"), F.sum("n_pred").alias("n_pred"))
    )
    cells = settle(cells)
    # one row per class, and the grid
    true = cells.filter("w_index = -1").select("class", F.col("n_pred").alias("n_true"))
    grid_rows = wide.sparkSession.range(n_weights).withColumnRenamed("id", "w_index")
    every = grid_rows.withColumn(
        "class", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(k - 1).cast("bigint")))
    )
    per_class = with_f1(
        every.join(cells, ["w_index", "class"], "left")
        .join(F.broadcast(true), "class", "left")
        .select(
            "w_index",
            "class",
            *[F.coalesce(c, F.lit(0)).alias(c) for c in ("tp", "n_true", "n_pred")],
        )
    )
    return per_class.groupBy("w_index").agg((F.sum("f1") / k).alias("macro_f1"))


def simplex_search(
    wide: DataFrame,
    candidates: Sequence[str],
    n_classes: int,
    steps: int = 10,
    top: int = 5,
) -> DataFrame:
    """The ``top`` mixtures by macro-F1: (rank, w_<candidate>.., macro_f1).

    Ties go to the lexicographically first weights. Tune on out-of-fold scores only.
    """
    parts = simplex_weights(len(candidates), steps)
    weights = [[p / steps for p in row] for row in parts]
    found = (
        search_weights(wide, candidates, weights, n_classes)
        .orderBy(quantise(F.col("macro_f1")).desc(), "w_index")
        .limit(top)
    )
    listed = small_table(
        wide.sparkSession,
        [(i, *w) for i, w in enumerate(weights)],
        {"w_index": pa.int64(), **{f"w_{c}": pa.float64() for c in candidates}},
    )
    # the grid has at most MAX_WEIGHTS rows, the result has `top`
    order = Window.orderBy(quantise(F.col("macro_f1")).desc(), "w_index")
    return (
        found.join(F.broadcast(listed), "w_index")
        .withColumn("rank", F.row_number().over(order))
        .select("rank", *[f"w_{c}" for c in candidates], "macro_f1")
    )


def best_weights(
    wide: DataFrame,
    candidates: Sequence[str],
    n_classes: int,
    steps: int = 10,
    refine: int = 0,
) -> list[float]:
    """Weights of the best mixture. ``refine`` rounds look closer around it, each with
    half the step, instead of one very fine grid."""
    row = simplex_search(wide, candidates, n_classes, steps, 1).first()
    best = [int(round(row[f"w_{c}"] * steps)) for c in candidates]
    m = len(candidates)
    for _ in range(refine):
        steps, best = steps * 2, [2 * b for b in best]
        near = sorted(
            {
                tuple(b + s for b, s in zip(best, shift))
                for shift in _shifts(m)
                if min(b + s for b, s in zip(best, shift)) >= 0
            }
        )
        found = search_weights(
            wide, candidates, [[p / steps for p in w] for w in near], n_classes
        )
        pick = found.orderBy(quantise(F.col("macro_f1")).desc(), "w_index").first()
        best = list(near[pick["w_index"]])
    return [b / steps for b in best]


def _shifts(m: int) -> list[tuple[int, ...]]:
    """Moves of up to one step per candidate that keep the sum."""
    moves = [()]
    for _ in range(m):
        moves = [(*s, d) for s in moves for d in (-1, 0, 1)]
    return [s for s in moves if sum(s) == 0]


def select_candidate(metrics: DataFrame, guards: DataFrame | None = None) -> DataFrame:
    """Rank candidates: (candidate, macro_f1, passes, rank, selected).

    Higher macro-F1 first, then the name. A candidate whose guard fails is ranked
    after all others and never selected. ``metrics`` has one row per candidate.
    """
    table = metrics.select("candidate", "macro_f1")
    if guards is None:
        table = table.withColumn("passes", F.lit(True))
    else:
        table = table.join(guards.select("candidate", "passes"), "candidate", "left")
        table = table.withColumn("passes", F.coalesce("passes", F.lit(False)))
    order = Window.orderBy(
        F.col("passes").desc(), quantise(F.col("macro_f1")).desc(), "candidate"
    )
    return table.withColumn("rank", F.row_number().over(order)).withColumn(
        "selected", (F.col("rank") == 1) & F.col("passes")
    )


def guard_class_count(
    base: DataFrame,
    candidates: DataFrame,
    cls,
    min_ratio: float,
    max_ratio: float,
    y_hat: str = "y_hat",
) -> DataFrame:
    """(candidate, n_base, n_candidate, ratio, passes) for the watched class.

    A candidate passes when it predicts the class between ``min_ratio`` and
    ``max_ratio`` times as often as the base submission does.
    """
    hit = F.sum((F.col(y_hat) == F.lit(cls)).cast("bigint"))
    n_base = base.agg(F.coalesce(hit, F.lit(0)).alias("n_base")).scalar()
    counts = candidates.groupBy("candidate").agg(
        F.coalesce(hit, F.lit(0)).alias("n_candidate")
    )
    ratio = F.try_divide(F.col("n_candidate").cast("double"), F.col("n_base"))
    return (
        counts.withColumn("n_base", n_base)
        .withColumn("ratio", ratio)
        .withColumn(
            "passes",
            F.when(
                F.col("n_base") > 0,
                F.col("ratio").between(F.lit(min_ratio), F.lit(max_ratio)),
            ).otherwise(F.col("n_candidate") == 0),
        )
        .select("candidate", "n_base", "n_candidate", "ratio", "passes")
    )

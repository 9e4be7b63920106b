"""From out-of-fold scores of several candidates to one submission."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.functions.scores import argmax_class
from tallyfold.operators.ensemble import (
    best_weights,
    fuse,
    guard_class_count,
    select_candidate,
)
from tallyfold.operators.metrics import macro_f1
from tallyfold.sources.shared import settle


def candidate_predictions(
    wide: DataFrame, candidates: Sequence[str], weights: Sequence[float], n_classes: int
) -> DataFrame:
    """(id, y, candidate, probs, y_hat) of every candidate and of their mixture, named
    ``fusion``."""
    named = [F.struct(F.lit(c).alias("candidate"), F.col(c).alias("probs")) for c in candidates]
    mixed = fuse(candidates, weights, n_classes)
    named.append(F.struct(F.lit("fusion").alias("candidate"), mixed.alias("probs")))
    long = wide.select("id", "y", F.inline(F.array(*named)))
    return long.withColumn("y_hat", argmax_class(F.col("probs"), n_classes))


def guard(pred: DataFrame, base: str, watched, low: float, high: float) -> DataFrame:
    """Guard every candidate's count of the watched class against one of them."""
    return guard_class_count(
        pred.filter(F.col("candidate") == base), pred, watched, low, high
    )


def selected_submission(
    wide: DataFrame,
    candidates: Sequence[str],
    n_classes: int,
    base: str,
    watched,
    low: float,
    high: float,
    steps: int = 10,
) -> DataFrame:
    """(id, candidate, y_hat) of the best candidate that passes the guard, the mixture
    with the best weights being one of them. Scores are written once and read by the
    search, the metrics and the choice."""
    scores = settle(wide)
    weights = best_weights(scores, candidates, n_classes, steps)
    pred = candidate_predictions(scores, candidates, weights, n_classes)
    f1 = macro_f1(pred, list(range(n_classes)), by=["candidate"])
    ranked = select_candidate(f1, guard(pred, base, watched, low, high))
    # one row
    choice = ranked.filter("selected").select("candidate").limit(1)
    return pred.join(F.broadcast(choice), "candidate").select("id", "candidate", "y_hat")

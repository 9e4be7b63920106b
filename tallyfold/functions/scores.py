"""Expressions on class scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SCORE_SCALE = 1e9
UNROLL_LIMIT = 32


def quantise(score: Column) -> Column:
    """Score as a whole number of 1e-9 steps; NaN counts as missing.

    Sums of doubles depend on the order in which partitions arrive. Comparing
    whole steps keeps that noise from flipping a class.
    """
    clean = F.nanvl(score, F.lit(None).cast("double"))
    return F.floor(clean * F.lit(SCORE_SCALE) + F.lit(0.5))


def quantised(value: float) -> int:
    """The same rule for a Python number (thresholds, band edges)."""
    return int((value * SCORE_SCALE + 0.5) // 1)


def argmax_of(scores: Sequence[Column], exact: bool = False) -> Column:
    """Index of the highest score, the lowest index on ties, null if all are missing.

    ``exact`` is for integer scores, which need no quantising.
    """
    step = (lambda s: s) if exact else quantise
    ranked = [
        F.struct(step(s).alias("q"), F.lit(-i).alias("k")) for i, s in enumerate(scores)
    ]
    best = ranked[0] if len(ranked) == 1 else F.greatest(*ranked)
    return F.when(best["q"].isNotNull(), -best["k"])


def argmax_class(probs: Column, n_classes: int) -> Column:
    """``argmax_of`` for an array column indexed by class."""
    if n_classes <= UNROLL_LIMIT:
        return argmax_of([F.get(probs, F.lit(i)) for i in range(n_classes)])
    best = F.array_max(
        F.transform(
            F.slice(probs, 1, n_classes),
            lambda p, i: F.struct(quantise(p).alias("q"), (-i).alias("k")),
        )
    )
    return F.when(best["q"].isNotNull(), -best["k"])


def max_prob(probs: Column) -> Column:
    """Highest entry of a probability array, NaN left out."""
    return F.array_max(F.filter(probs, lambda p: ~F.isnan(p)))


def decide(p: Column, threshold: float) -> Column:
    """1 when ``p`` is at or above the threshold, else 0; null stays null."""
    return F.when(quantise(p).isNull(), F.lit(None)).otherwise(
        (quantise(p) >= F.lit(quantised(threshold))).cast("int")
    )


def gated_decide(
    p_label: Column, class_probs: Column, threshold: float, n_classes: int
) -> Column:
    """0 below the label threshold, the best class among 1 .. n_classes-1 from it on, null
    where the label's probability is null or NaN."""
    inner = F.slice(class_probs, 2, n_classes - 1)
    q, edge = quantise(p_label), F.lit(quantised(threshold))
    return F.when(q < edge, F.lit(0)).when(q >= edge, argmax_class(inner, n_classes - 1) + 1)


def softmax(scores: Sequence[Column]) -> list[Column]:
    """Softmax over columns, shifted by the largest score."""
    top = F.greatest(*scores)
    exps = [F.exp(s - top) for s in scores]
    total = exps[0]
    for e in exps[1:]:
        total = total + e
    return [e / total for e in exps]

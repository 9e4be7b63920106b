"""Fusion weights without a grid: exact line search, and greedy selection of models."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.functions.scores import SCORE_SCALE, quantise
from tallyfold.operators.metrics import macro_f1_of
from tallyfold.operators.skew import running_sums
from tallyfold.sources.shared import settle, small_table

#: A line's parameter, from 0 to 1, is told in whole steps of 1 / LINE_STEPS.
LINE_STEPS = 1_000_000_000
#: F1 scores are added up in whole steps of 1 / F1_STEPS, so their order doesn't matter.
F1_STEPS = 1_000_000_000_000


# --- exact line search ------------------------------------------------------------------


def upper_envelope(base: np.ndarray, slope: np.ndarray) -> tuple[np.ndarray, list[tuple]]:
    """The best class of each row along base + t * slope, t from 0 to 1.

    Returns the class right after t = 0 and the changes [(rows, t, old, new)]. Ties go to the
    class that rises fastest, being the best right after, then to the lowest class.
    """
    n, k = base.shape
    rows, classes = np.arange(n), np.arange(k)

    def best(value: np.ndarray, rise: np.ndarray, among: np.ndarray) -> np.ndarray:
        """Lowest class with the highest (value, rise) among those allowed."""
        value = np.where(among, value, -np.inf)
        top = among & (value == value.max(axis=1, keepdims=True))
        rise = np.where(top, rise, -np.inf)
        return np.where(top & (rise == rise.max(axis=1, keepdims=True)), classes, k).min(axis=1)

    now = best(base, slope, np.ones((n, k), bool)) if n else np.zeros(0, "int64")
    first, changes = now, []
    live, at = rows, np.zeros(n)
    while len(live):
        own_base, own_slope = base[live, now[live]][:, None], slope[live, now[live]][:, None]
        faster = slope[live] > own_slope
        with np.errstate(divide="ignore", invalid="ignore"):
            t = np.where(faster, (own_base - base[live]) / (slope[live] - own_slope), np.inf)
        # rounding may put a crossing a little before the last one
        t = np.maximum(t, at[live][:, None])
        soonest = t.min(axis=1)
        new = best(-t, slope[live], faster)
        moving = soonest < 1
        live, soonest, new = live[moving], soonest[moving], new[moving]
        if len(live):
            changes.append((live, soonest, now[live], new))
            now = now.copy()
            now[live] = new
            at[live] = soonest
    return first, changes


def line_events(
    wide: DataFrame,
    candidates: Sequence[str],
    start: Sequence[float],
    ends: Sequence[Sequence[float]],
    n_classes: int,
    y: str = "y",
) -> DataFrame:
    """(line, t, class, tp, n_pred, n_true): how the counts of a class change at step t of the
    way from the ``start`` to each of the ``ends``, numbered as ``line``. At t = 0 stand the
    counts with which the line begins, and those of true rows. Scores count in whole steps of
    1e-9; NaN counts as less than any score."""
    names, k = list(candidates), n_classes
    low, highs = np.array(start, "float64"), np.array(ends, "float64")

    def along(line: int, high: np.ndarray, stacks: np.ndarray, truth: np.ndarray) -> Iterator[list[np.ndarray]]:
        base, there = np.tensordot(low, stacks, 1), np.tensordot(high, stacks, 1)
        first, changes = upper_envelope(base, there - base)

        def told(step, cls, tp, n_pred, n_true):
            size = np.zeros(len(cls), "int64")
            return [size + line, size + step, cls, size + tp, size + n_pred, size + n_true]

        yield told(0, first, first == truth, 1, 0)
        yield told(0, truth, 0, 0, 1)
        for rows, t, old, new in changes:
            step = np.floor(t * LINE_STEPS + 0.5).astype("int64")
            yield told(step, old, -1 * (old == truth[rows]), -1, 0)
            yield told(step, new, new == truth[rows], 1, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            truth = batch.column(0).to_numpy(zero_copy_only=False)
            stacks = np.zeros((len(names), len(truth), k))
            for i in range(len(names)):
                flat = batch.column(i + 1).flatten().to_numpy(zero_copy_only=False)
                stacks[i] = np.floor(flat.reshape(len(truth), -1)[:, :k] * SCORE_SCALE + 0.5)
            stacks = np.nan_to_num(stacks, nan=-SCORE_SCALE)
            for line, high in enumerate(highs):
                parts = list(along(line, high, stacks, truth))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([p[i] for p in parts]), pa.int64()) for i in range(6)],
                    ["line", "t", "class", "tp", "n_pred", "n_true"],
                )

    labelled = wide.filter(F.col(y).isNotNull()).select(F.col(y).cast("bigint").alias("_y"), *names)
    kinds = ", ".join(f"{c} bigint" for c in ("line", "t", "class", "tp", "n_pred", "n_true"))
    inside = labelled.mapInArrow(run, kinds).filter(F.col("class").between(0, k - 1))
    return inside.groupBy("line", "t", "class").agg(*[F.sum(c).alias(c) for c in ("tp", "n_pred", "n_true")])


def _f1_steps(tp: Column, n_pred: Column, n_true: Column) -> Column:
    share = F.when(n_pred + n_true > 0, 2.0 * tp / (n_pred + n_true)).otherwise(F.lit(0.0))
    return F.floor(share * F1_STEPS + 0.5)


def line_curve(events: DataFrame, n_classes: int) -> DataFrame:
    """(line, t, until, macro_f1): macro-F1 on each interval between changes, from 0 to 1.

    Each class's counts are summed over its own changes, then the changes of its F1 over all
    classes: two scans in ranges of (line, t); no task holds a line or a class.
    """
    events = settle(events)
    true = events.groupBy("line", "class").agg(F.sum("n_true").alias("all_true"))
    # one row a line and class
    moved = events.filter("tp <> 0 or n_pred <> 0 or t = 0").join(F.broadcast(true), ["line", "class"])
    summed = running_sums(moved, ["line", "class"], ["t"], {"tp_now": F.col("tp"), "pred_now": F.col("n_pred")})
    now = _f1_steps(F.col("tp_now"), F.col("pred_now"), F.col("all_true"))
    before = _f1_steps(F.col("tp_now") - F.col("tp"), F.col("pred_now") - F.col("n_pred"), F.col("all_true"))
    gains = summed.select("line", "t", F.when(F.col("t") == 0, now).otherwise(now - before).alias("gain"))
    steps = gains.groupBy("line", "t").agg(F.sum("gain").alias("gain"))
    total = settle(running_sums(steps, ["line"], ["t"], {"f1": F.col("gain")}))
    # the next change: of a part's last row, the first of a later part; at most 1,025 parts a line
    marked = total.withColumn("_part", F.floor(F.col("t") / (LINE_STEPS // 1024)))
    firsts = marked.groupBy("line", "_part").agg(F.min("t").alias("first"))
    over_parts = Window.partitionBy("line").orderBy("_part")
    later = firsts.select("line", "_part", F.lead("first").over(over_parts).alias("later"))
    inside = Window.partitionBy("line", "_part").orderBy("t")
    return (
        marked.join(later, ["line", "_part"])
        .withColumn("until", F.coalesce(F.lead("t").over(inside), "later", F.lit(LINE_STEPS)))
        .select("line", "t", "until", (F.col("f1") / F1_STEPS / n_classes).alias("macro_f1"))
        .filter("t < until")
    )


def line_search(
    wide: DataFrame,
    candidates: Sequence[str],
    start: Sequence[float],
    n_classes: int,
    y: str = "y",
) -> DataFrame:
    """(towards, n_intervals, t, macro_f1, start_f1): the best mixture on the way from the
    ``start`` weights to each single candidate, found exactly, all ways in one pass.

    Along a line a row's scores are straight, so its class changes only where two cross;
    between crossings macro-F1 is constant. ``t`` is the middle of the first best interval.
    Without labelled rows there is no way to search.
    """
    names = list(candidates)
    ends = [[float(i == j) for j in range(len(names))] for i in range(len(names))]
    curve = line_curve(line_events(wide, names, start, ends, n_classes, y), n_classes)
    best = F.max_by(F.struct("t", "until", "macro_f1"), F.struct(quantise(F.col("macro_f1")), -F.col("t")))
    found = curve.groupBy("line").agg(
        F.count(F.lit(1)).alias("n_intervals"), best.alias("best"), F.min_by("macro_f1", "t").alias("start_f1")
    )
    return found.select(
        F.element_at(F.array(*map(F.lit, names)), (F.col("line") + 1).cast("int")).alias("towards"),
        "n_intervals",
        ((F.col("best.t") + F.col("best.until")) / 2 / LINE_STEPS).alias("t"),
        F.col("best.macro_f1").alias("macro_f1"),
        "start_f1",
    )


def ascend(
    wide: DataFrame,
    candidates: Sequence[str],
    n_classes: int,
    start: Sequence[float] | None = None,
    y: str = "y",
    most_rounds: int = 20,
) -> tuple[list[float], list[float]]:
    """Weights from which no line to a single candidate leads higher, and the macro-F1 after
    each step. Starts from an even mixture; tune on out-of-fold scores only."""
    m = len(candidates)
    now, path = list(start or [1 / m] * m), []
    for _ in range(most_rounds):
        rows = line_search(wide, candidates, now, n_classes, y).collect()
        if not rows:
            break
        best = max(rows, key=lambda r: (round(r["macro_f1"] * SCORE_SCALE), -list(candidates).index(r["towards"])))
        path = path or [best["start_f1"]]
        if round(best["macro_f1"] * SCORE_SCALE) <= round(best["start_f1"] * SCORE_SCALE):
            break
        i = list(candidates).index(best["towards"])
        now = [(1 - best["t"]) * w + best["t"] * (j == i) for j, w in enumerate(now)]
        path.append(best["macro_f1"])
    return now, path


# --- greedy selection -------------------------------------------------------------------


def _stacked(scores: DataFrame, model: Sequence[str], id_col: str, y: str) -> tuple[DataFrame, list[tuple]]:
    """(y, probs of all models one after the other), and the models in order. An id that
    lacks a model, or has it twice, fails."""
    models = [tuple(r) for r in scores.select(*model).distinct().orderBy(*model).collect()]
    by_id = scores.filter(F.col(y).isNotNull()).groupBy(id_col).agg(
        F.max(y).alias("y"),
        F.array_sort(F.collect_list(F.struct(*model, "probs"))).alias("rows"),
        F.countDistinct(*model).alias("n"),
    )
    whole = (F.col("n") == len(models)) & (F.size("rows") == len(models))
    text = F.concat(F.lit("missing or repeated scores for id "), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))
    checked = F.when(whole, F.flatten(F.col("rows.probs"))).otherwise(F.raise_error(text).cast("array<double>"))
    return by_id.select(F.col("y").cast("bigint").alias("y"), checked.alias("probs")), models


def greedy_selection(
    scores: DataFrame,
    n_classes: int,
    model: Sequence[str] = ("candidate", "seed"),
    steps: int = 10,
    id_col: str = "id",
    y: str = "y",
) -> DataFrame:
    """(step, model.., macro_f1): models picked one after the other, with replacement.

    Each step adds the model whose scores, added to those picked so far, give the highest
    macro-F1; ties go to the first model. How often a model is picked is its weight. All
    models of an id are brought together once; a step is one pass that tries every model and
    hands on counts per (model, true, predicted). Scores count in whole steps of 1e-9.
    """
    wide, models = _stacked(scores, model, id_col, y)
    rows, k, m = settle(wide), n_classes, len(models)
    rows_at_once = max(1, 4_000_000 // max(1, m * k))
    picked, told = np.zeros(m, "int64"), []

    def tried(weights: np.ndarray) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((m, k, k), "int64")
            for batch in batches:
                truth = batch.column(0).to_numpy(zero_copy_only=False)
                flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(truth), m, -1)
                for lo in range(0, len(truth), rows_at_once):
                    part = np.nan_to_num(flat[lo : lo + rows_at_once, :, :k], nan=-1.0)
                    q = np.floor(part * SCORE_SCALE + 0.5).astype("int64")
                    mixed = q + np.tensordot(weights, q, (0, 1))[:, None, :]
                    best = mixed.argmax(axis=2)
                    own = truth[lo : lo + rows_at_once]
                    inside = (own >= 0) & (own < k)
                    cell = (np.arange(m) * k + own[inside, None]) * k + best[inside]
                    total += np.bincount(cell.ravel(), minlength=m * k * k).reshape(total.shape)
            i, true, said = np.nonzero(total)
            columns = [i, true, said, total[i, true, said]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["model", "y", "y_hat", "n"])

        found = rows.mapInArrow(run, "model bigint, y bigint, y_hat bigint, n bigint")
        return found.groupBy("model", "y", "y_hat").agg(F.sum("n").alias("n"))

    for step in range(1, steps + 1):
        f1 = macro_f1_of(tried(picked.copy()), list(range(k)), ["model"])
        best = f1.orderBy(quantise(F.col("macro_f1")).desc(), "model").first()
        if best is None:
            break
        picked[best["model"]] += 1
        told.append((step, *models[best["model"]], best["macro_f1"]))
    kinds = {f.name: pa.string() if f.dataType.simpleString() == "string" else pa.int64() for f in scores.select(*model).schema.fields}
    return small_table(scores.sparkSession, told, {"step": pa.int32(), **kinds, "macro_f1": pa.float64()})

"""Quality classifier: naive Bayes support vectors.

A document is the set of its words, runs of marks, and pairs of neighbours. Each of these
n-grams weighs its log-count ratio between the two classes; a linear hinge-loss model over
the weighted indicators is fitted by dual coordinate descent, and a logistic curve on
documents left out of that fit turns its margin into a probability.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import held_out, map_texts, sample_by_class

TOKENS = re.compile(r"\w+|[^\w\s]+")
DOCS_PER_CLASS = 3000
MIN_DOCS = 3
MAX_FEATURES = 200_000
ROUNDS = 20
COST = 1.0
THRESHOLD = 0.7
BLANK = "<blank>"


def features_of(text: str | None) -> set:
    """The distinct n-grams: words as strings, pairs as tuples."""
    tokens = TOKENS.findall((text or "").lower())
    if not tokens:
        return {BLANK}
    return {*tokens, *zip(tokens, tokens[1:])}


@dataclass
class Model:
    """Weight of each n-gram (ratio times support-vector weight), and its ratio."""

    weights: dict = field(default_factory=dict)
    ratios: dict = field(default_factory=dict)
    bias: float = 0.0
    slope: float = 0.0
    offset: float = 0.0

    def margin(self, text: str | None) -> float:
        dot = norm = 0.0
        ratios, weights = self.ratios, self.weights
        found = [f for f in features_of(text) if f in ratios]
        for f in found:
            norm += ratios[f] ** 2
            dot += weights[f]
        return dot / norm**0.5 + self.bias if norm else self.bias

    def score(self, text: str | None) -> float:
        return float(_logistic(self.slope * self.margin(text) + self.offset))


def _logistic(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))


def dual_coordinate_descent(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, n: int,
                            cost: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Weights (last: bias) of min |w|^2 / 2 + sum cost_i max(0, 1 - y_i w x_i).

    ``rows``: (feature numbers, values). Each step solves one document's dual variable
    exactly, in a new random order each round; ends when no variable moves any more.
    """
    w, alpha = np.zeros(n + 1), np.zeros(len(rows))
    square = np.array([v @ v + 1.0 for _, v in rows])
    order = np.random.default_rng(1)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(rows)):
            index, value = rows[i]
            slack = y[i] * (w[index] @ value + w[n]) - 1.0
            new = min(max(alpha[i] - slack / square[i], 0.0), cost[i])
            if change := (new - alpha[i]) * y[i]:
                w[index] += change * value
                w[n] += change
                alpha[i] = new
                moved = max(moved, abs(change))
        if moved < 1e-3:
            break
    return w


def calibrate(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by damped Newton steps."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = _logistic(a * margin + b)
        pull = weight * (p - y)
        bend = weight * p * (1 - p)
        g = np.array([pull @ margin + 1e-3 * a, pull.sum()])
        h = np.array([[bend @ margin**2, bend @ margin], [bend @ margin, bend.sum()]])
        step = np.linalg.solve(h + 1e-3 * np.eye(2), g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def one_label(labels: DataFrame, key: str, label: str) -> DataFrame:
    """(key, y): the larger label where a key has several; rows without key or label go."""
    return (
        labels.select(F.col(key), F.col(label).cast("int").alias("y"))
        .filter(F.col(key).isNotNull() & F.col("y").isin(0, 1))
        .groupBy(key)
        .agg(F.max("y").alias("y"))
    )


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id",
        label: str = "quality", per_class: int = DOCS_PER_CLASS) -> Model:
    """Fit on about ``per_class`` labelled documents of each class, whole, chosen by a hash
    of the key. ``labels`` has the key and a label 0 or 1; pass only what may be learnt.

    N-grams are counted in tasks; those in ``MIN_DOCS`` documents at least, the
    ``MAX_FEATURES`` most frequent of them, form the model, so its size is bounded. With no
    labelled document, or one class only, every text scores the share of label 1 (0.5).
    """
    marked = one_label(labels, key, label)
    counts = {r["y"]: r["count"] for r in marked.groupBy("y").count().collect()}
    total = sum(counts.values())
    if len(counts) < 2:
        share = (counts.get(1, 0) + 1) / (total + 2)
        return Model(offset=float(np.log(share / (1 - share))))
    chosen = sample_by_class(marked, key, "y", per_class, "quality")
    sample = (
        docs.select(key, F.col(text).alias("text"))
        .join(F.broadcast(chosen), key)
        .select(F.xxhash64(key).alias("id"), "y", "text")
    )

    def listed(texts):
        found = [sorted(" ".join(f) if isinstance(f, tuple) else f for f in features_of(t)) for t in texts]
        return {"features": pa.array(found, pa.list_(pa.string()))}

    grams = map_texts(sample, "text", "features array<string>", listed).withColumn(
        "feature", F.explode("features")
    )
    seen = (
        grams.groupBy("feature")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("good"))
        .filter(F.col("n") >= MIN_DOCS)
        .orderBy(F.desc("n"), "feature")
        .limit(MAX_FEATURES)
        .toArrow()
    )
    names = seen["feature"].to_pylist()
    number = {name: i for i, name in enumerate(names)}
    good = seen["good"].to_numpy().astype(float)
    bad = seen["n"].to_numpy().astype(float) - good
    ratio = np.log((good + 1) / (good + 1).sum()) - np.log((bad + 1) / (bad + 1).sum())
    shared = docs.sparkSession.sparkContext.broadcast(number)

    def numbered(texts):
        get = shared.value.get
        found = [
            sorted(i for f in features_of(t) if (i := get(" ".join(f) if isinstance(f, tuple) else f)) is not None)
            for t in texts
        ]
        return {"found": pa.array(found, pa.list_(pa.int32()))}

    # flat arrays: the n-grams of all rows one after the other, four bytes each
    listed_rows = map_texts(sample, "text", "found array<int>", numbered)
    told = listed_rows.orderBy("id", "y", F.size("found")).toArrow().combine_chunks()
    shared.destroy()
    rows = []
    if told.num_rows:
        found = told["found"].combine_chunks()
        index, ends = found.flatten().to_numpy(), found.offsets.to_numpy() - found.offsets[0].as_py()
        for start, end in zip(ends[:-1], ends[1:]):
            value = ratio[index[start:end]]
            norm = np.sqrt(value @ value)
            rows.append((index[start:end], value / norm if norm else value))
    y = 2 * told["y"].to_numpy().astype(int) - 1
    left_out = told["id"].to_numpy() % 4 == 0
    if not rows:
        share = (counts[1] + 1) / (total + 2)
        return Model(offset=float(np.log(share / (1 - share))))
    balance = np.where(y > 0, len(y) / 2 / max(1, (y > 0).sum()), len(y) / 2 / max(1, (y < 0).sum()))
    learn = np.flatnonzero(~left_out) if len(set(y[~left_out])) == 2 else np.arange(len(y))
    w = dual_coordinate_descent([rows[i] for i in learn], y[learn], len(number), COST * balance[learn])
    check = np.flatnonzero(left_out) if len(set(y[left_out])) == 2 else np.arange(len(y))
    margin = np.array([w[rows[i][0]] @ rows[i][1] + w[-1] for i in check])
    prior = np.where(y > 0, counts[1] / max(1, (y[check] > 0).sum()), counts[0] / max(1, (y[check] < 0).sum()))
    slope, offset = calibrate(margin, (y[check] > 0).astype(float), prior[check] * len(check) / total)

    def back(feature: str):
        return tuple(feature.split(" ")) if " " in feature else feature

    grams_of_model = [back(f) for f in names]
    return Model(
        dict(zip(grams_of_model, (ratio * w[:-1]).tolist())),
        dict(zip(grams_of_model, ratio.tolist())),
        float(w[-1]),
        slope,
        offset,
    )


def quality_scores(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Replace the text by ``score``, 0 to 1: how likely label 1 is. Null and empty texts
    score as texts without any known n-gram; repeated rows score alike. Whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(texts):
        return {"score": pa.array([shared.value.score(t) for t in texts], pa.float64())}

    return map_texts(docs, text, "score double", scored)


def keep(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows, with their columns, whose text scores ``threshold`` at least."""
    rows = docs.select(
        *[F.col(c).alias(f"_{i}") for i, c in enumerate(docs.columns)], F.col(text).alias("_text")
    )
    scored = quality_scores(rows, model, "_text").filter(F.col("score") >= threshold)
    return scored.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns)])


def learnable(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    return labels.filter(~held_out(F.col(key)))


def predicted(score: Column, threshold: float = THRESHOLD) -> Column:
    return (score >= threshold).cast("int")


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    model = fit(docs, learnable(labels))
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return quality_scores(rows, model).withColumn("predicted", predicted(F.col("score")))

"""Candidate models: each gives ``probs``, an array indexed by class."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.functions.scores import argmax_class, softmax
from tallyfold.functions.text import tokens
from tallyfold.operators import boosting
from tallyfold.operators.folds import oof
from tallyfold.operators.keys import MAX_FOLDS, NO_FOLD, fold_counts, own_fold, prior_counts
from tallyfold.operators.skew import (
    BROADCAST_BYTES,
    KeyTable,
    frequent_from,
    key_table,
    lookup_join,
)
from tallyfold.sources.shared import settle, shared_folder

MAX_MODEL_VALUES = 20_000_000
PIECE_BYTES = 2 << 20
ASCII_TOKENS = bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else 32 for b in range(256))


# --- class centroids -----------------------------------------------------------


def fit_centroids(
    df: DataFrame, x: str, y: str, fold: str, n_classes: int
) -> dict[int, np.ndarray]:
    """Class centroids per fold, made from all other folds; -1 is made from all rows.

    One grouped pass. The model is folds x classes x dimensions numbers and is
    checked before it is brought to the driver.
    """
    sums = (
        df.filter(F.col(y).between(0, n_classes - 1) & F.col(x).isNotNull())
        .filter(F.col(fold).between(0, MAX_FOLDS - 1))
        .groupBy(F.col(fold).alias("f"), F.col(y).alias("c"))
        .agg(
            Summarizer.metrics("sum", "count")
            .summary(array_to_vector(F.col(x).cast("array<double>")))
            .alias("s")
        )
        .select("f", "c", vector_to_array("s.sum").alias("sum"), F.col("s.count").alias("n"))
    )
    rows, most = [], None
    for row in sums.toLocalIterator():
        most = most or MAX_MODEL_VALUES // len(row["sum"])
        rows.append(row)
        if len(rows) > most:
            raise ValueError(f"the centroids exceed {MAX_MODEL_VALUES} numbers")
    if not rows:
        raise ValueError("no labelled rows")
    dims = len(rows[0]["sum"])
    own = {r["f"]: (np.zeros((n_classes, dims)), np.zeros(n_classes)) for r in rows}
    for r in rows:
        own[r["f"]][0][r["c"]] = r["sum"]
        own[r["f"]][1][r["c"]] = r["n"]
    total = sum(s for s, _ in own.values())
    count = sum(n for _, n in own.values())
    model = {}
    for f, (s, n) in {**own, NO_FOLD: (0.0 * total, 0.0 * count)}.items():
        left = count - n
        with np.errstate(invalid="ignore", divide="ignore"):
            model[f] = np.where(left[:, None] > 0, (total - s) / left[:, None], np.nan)
    return model


def score_centroids(
    df: DataFrame,
    model: dict[int, np.ndarray],
    x: str,
    keep: Sequence[str],
    fold: str,
    candidates: Sequence[tuple[str, int, Sequence[int]]],
) -> DataFrame:
    """Long scores of (candidate, seed, dimensions) variants: softmax of minus the
    squared distance over those dimensions. A class without a centroid gets 0. Rows
    outside the model's folds are scored by the centroids of all rows."""
    picks = [(name, seed, np.array(list(dims))) for name, seed, dims in candidates]
    kept = list(keep)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            points = np.stack(batch["_x"].to_numpy()).astype("float64")
            folds = batch["_f"].to_numpy()
            for name, seed, dims in picks:
                probs = np.empty((len(batch), len(model[NO_FOLD])))
                for f in np.unique(folds):
                    at = folds == f
                    centre = model.get(int(f), model[NO_FOLD])[:, dims]
                    part = points[at][:, dims]
                    gap = np.stack([((part - c) ** 2).sum(axis=1) for c in centre], axis=1)
                    logit = np.where(np.isnan(gap), -np.inf, -gap)
                    logit = np.exp(logit - logit.max(axis=1, keepdims=True))
                    probs[at] = logit / logit.sum(axis=1, keepdims=True)
                out = batch[kept].copy()
                out["candidate"], out["seed"], out["view"] = name, seed, 0
                out["probs"] = list(probs)
                yield out

    types = dict(df.dtypes)
    fields = ", ".join(f"`{c}` {types[c]}" for c in kept)
    return (
        df.filter(F.col(x).isNotNull())
        .select(
            *kept,
            F.coalesce(F.col(fold), F.lit(NO_FOLD)).alias("_f"),
            F.col(x).alias("_x"),
        )
        .mapInPandas(run, f"{fields}, candidate string, seed int, view int, probs array<double>")
    )


# --- naive Bayes on tokens -----------------------------------------------------


def naive_bayes_scores(
    df: DataFrame,
    id_col: str,
    text: str,
    y: str,
    fold: str,
    n_classes: int,
    n_folds: int,
    alpha: float = 1.0,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """(id, fold, y, probs): multinomial naive Bayes, labelled rows scored by the
    other folds, unlabelled ones (fold -1) by all labels.

    Token counts of labelled texts per (token, fold) are joined to the tokens of each
    text. What of that table can be broadcast, all of it or its most frequent tokens, is
    summed in the task that reads the text. Only the other tokens are counted per text,
    sent and joined, with frequent ones split.
    """
    classes = list(range(n_classes))
    texts = df.select(
        id_col,
        F.col(y).alias("y"),
        own_fold(y, fold, n_folds).alias("_fold"),
        F.col(text).alias("_text"),
    )
    # a null token per text counts the texts themselves and keeps empty ones
    words = F.concat(tokens(F.col("_text")), F.array(F.lit(None).cast("string")))
    docs = texts.select(id_col, "y", "_fold", F.explode_outer(words).alias("token"))
    counted = key_table(_with_all_labels(docs.filter(F.col("y").isNotNull()), classes, n_folds))
    counts = counted.table
    by_token = counts.filter(F.col("token").isNotNull())
    left = sum([F.col(f"l{i}") for i in classes[1:]], F.col("l0"))
    vocabulary = by_token.filter((F.col("_fold") == NO_FOLD) & (left > 0)).count()
    prior = prior_counts(counts.filter(F.col("token").isNull()), n_classes).select(
        "_fold", *[F.col(f"p{c}").alias(f"d{c}") for c in classes]
    )
    # one row per fold
    totals = prior.join(F.broadcast(prior_counts(by_token, n_classes)), "_fold", "left")

    # what a token adds that no other fold has
    unknown = F.log(F.lit(alpha))
    logs = [F.log(F.col(f"l{c}") + alpha).alias(f"w{c}") for c in classes]
    weights = counted.filter(F.col("token").isNotNull())
    weights = weights.select("token", "_fold", "n_rows", *logs)
    by_text = [id_col, "y", "_fold"]
    if weights.is_small(broadcast_bytes):
        joined = lookup_join(
            docs.withColumn("n", F.lit(1)), weights, ["token", "_fold"], [id_col, "token"],
            broadcast_bytes=broadcast_bytes,
        )
        scores = [
            F.when(F.col("token").isNotNull(), F.col("n") * F.coalesce(F.col(f"w{c}"), unknown))
            for c in classes
        ]
        number = F.when(F.col("token").isNotNull(), F.col("n")).otherwise(F.lit(0))
    else:
        least = frequent_from(weights, broadcast_bytes)
        sums = settle(_frequent_sums(texts, weights, least, n_classes))
        # a token that no other fold has needs no row
        rare = F.lit(True) if least is None else F.col("n_rows") < least
        rest = replace(counted.filter(F.col("token").isNotNull() & rare & (left > 0)), weight=None)
        joined = lookup_join(
            sums,
            rest.select("token", "_fold", *logs),
            ["token", "_fold"],
            [id_col, "token"],
            broadcast_bytes=broadcast_bytes,
        )
        scores = [
            F.when(F.col("token").isNull(), F.col(f"k{c}")).otherwise(
                F.col("n") * F.coalesce(F.col(f"w{c}"), unknown)
            )
            for c in classes
        ]
        number = F.col("n")
    summed = joined.groupBy(*by_text).agg(
        F.sum(number).alias("_n"),
        *[F.coalesce(F.sum(scores[c]), F.lit(0.0)).alias(f"s{c}") for c in classes],
    )
    labels = sum([F.col(f"d{c}") for c in classes[1:]], F.col("d0"))
    logits = [
        F.col(f"s{c}")
        - F.col("_n") * F.log(F.coalesce(F.col(f"p{c}"), F.lit(0)) + alpha * vocabulary)
        + F.log((F.col(f"d{c}") + alpha) / (labels + alpha * n_classes))
        for c in classes
    ]
    return summed.join(F.broadcast(totals), "_fold", "left").select(
        id_col, F.col("_fold").alias("fold"), "y", F.array(*softmax(logits)).alias("probs")
    )


def _with_all_labels(labelled: DataFrame, classes: Sequence[int], n_folds: int) -> DataFrame:
    """fold_counts of the tokens of labelled texts, and a row of fold -1 for each token,
    whose other folds are all folds."""
    # side by side, the sums of all folds and classes take longer than a sort
    counts = fold_counts(labelled, "token", "y", "_fold", classes, n_folds, wide_columns=0)
    same = Window.partitionBy("token")
    first = F.min("_fold").over(same) == F.col("_fold")
    names = [f"n{c}" for c in classes], [f"l{c}" for c in classes]
    own = F.struct("_fold", "n_rows", *names[0], *names[1])
    whole = F.struct(
        F.lit(NO_FOLD).alias("_fold"),
        F.col("_rows").alias("n_rows"),
        *[F.lit(0).cast("bigint").alias(n) for n in names[0]],
        *[(F.col(n) + F.col(left)).alias(left) for n, left in zip(*names)],
    )
    return (
        counts.withColumn("_rows", F.sum("n_rows").over(same))
        .withColumn("_first", first)
        .select("token", F.inline(F.when(F.col("_first"), F.array(own, whole)).otherwise(F.array(own))))
    )


def _ascii_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The tokens of ASCII texts and how many each has; null and empty texts have none. Where
    all is ASCII, a token is a run of letters and digits, and lower case goes byte by byte."""
    encoded = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in texts]
    # a blank after each text ends its last token
    joined = b" ".join([*encoded, b""]).translate(ASCII_TOKENS)
    data = np.frombuffer(joined, np.uint8)
    inside = np.zeros(len(data) + 1, np.int8)
    inside[1:] = data != 32
    edges = np.flatnonzero(np.diff(inside))
    ends = np.cumsum([0, *[len(t) + 1 for t in encoded]])
    offsets = np.zeros(len(edges) // 2 + 1, np.int64)
    np.cumsum(edges[1::2] - edges[::2], out=offsets[1:])
    letters = pa.py_buffer(joined.translate(None, b" "))
    words = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), letters)
    return words, np.diff(np.searchsorted(edges[::2], ends))


def _token_pieces(
    batches: Iterator[pa.RecordBatch],
) -> Iterator[tuple[pa.RecordBatch, pa.Array, np.ndarray, np.ndarray]]:
    """Rows whose last columns are an ASCII text and the tokens of any other text, about
    ``PIECE_BYTES`` of both at a time: the rows, their distinct tokens, and for each of their
    tokens its number among those and its row's."""
    for batch in batches:
        ascii_texts, others = batch.columns[-2:]
        size = pc.add(
            pc.binary_length(ascii_texts).fill_null(0).cast(pa.int64()),
            pc.multiply(pc.list_value_length(others).fill_null(0).cast(pa.int64()), 8),
        )
        upto = np.cumsum(size.to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            before = upto[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(upto, before + PIECE_BYTES, "right")))
            rows = batch.slice(start, end - start)
            ascii_texts, others = rows.columns[-2:]
            words, n = _ascii_words(ascii_texts)
            n_others = pc.list_value_length(others).fill_null(0).to_numpy(zero_copy_only=False)
            found = pa.concat_arrays([words, others.flatten().cast(words.type)]).dictionary_encode()
            number = np.arange(end - start)
            row = np.concatenate([np.repeat(number, n), np.repeat(number, n_others)])
            yield rows, found.dictionary, found.indices.to_numpy().astype(np.int64), row
            start = end


def _frequent_sums(texts: DataFrame, weights: KeyTable, least: int | None, n_classes: int) -> DataFrame:
    """(id, y, _fold, token, n, k0 .. kK-1): one row with a null token for each text, with the
    number and summed weights of its tokens of at least ``least`` rows, and one with the
    number for each of its other tokens.

    The frequent tokens, no more than fit a broadcast, go to the tasks as arrays. ASCII texts
    are cut there, at a fraction of what the pattern takes; all others by the pattern."""
    names = [f"w{c}" for c in range(n_classes)]
    frequent = weights.filter(F.lit(False) if least is None else F.col("n_rows") >= least)
    listed = frequent.table.select("token", "_fold", *names).toArrow()
    coded = listed.column("token").cast(pa.large_string()).combine_chunks().dictionary_encode()
    known = coded.dictionary
    n_folds = max([0, *listed.column("_fold").to_pylist()]) + 2
    table = np.full((max(1, len(known)) * n_folds, n_classes), np.nan)
    at = coded.indices.to_numpy().astype(np.int64) * n_folds + listed.column("_fold").to_numpy() + 1
    for c, name in enumerate(names):
        table[at, c] = listed.column(name).to_numpy()
    shared = texts.sparkSession.sparkContext.broadcast((known, n_folds, table))
    ks = [f"k{c}" for c in range(n_classes)]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n_folds, table = shared.value
        for rows, distinct, token, row in _token_pieces(batches):
            fold = rows.column(2).to_numpy().astype(np.int64) + 1
            place = pc.index_in(distinct, known).fill_null(-1).to_numpy().astype(np.int64)[token]
            cell = np.where((place >= 0) & (fold[row] < n_folds), place * n_folds + fold[row], -1)
            hit = (cell >= 0) & ~np.isnan(table[cell, 0])
            sums = [np.bincount(row[hit], table[cell[hit], c], rows.num_rows) for c in range(len(ks))]
            pairs, n = np.unique(row[~hit] * len(distinct) + token[~hit], return_counts=True)
            own = rows.select(rows.schema.names[:3])
            yield pa.RecordBatch.from_arrays(
                [
                    *own.columns,
                    pa.nulls(rows.num_rows, pa.string()),
                    pa.array(np.bincount(row[hit], minlength=rows.num_rows), pa.int64()),
                    *[pa.array(s, pa.float64()) for s in sums],
                ],
                [*own.schema.names, "token", "n", *ks],
            )
            if len(pairs):
                others = own.take(pa.array(pairs // len(distinct)))
                yield pa.RecordBatch.from_arrays(
                    [
                        *others.columns,
                        distinct.take(pa.array(pairs % len(distinct))).cast(pa.string()),
                        pa.array(n, pa.int64()),
                        *[pa.nulls(len(n), pa.float64()) for _ in ks],
                    ],
                    [*own.schema.names, "token", "n", *ks],
                )

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields[:3]]
    plain = F.length("_text") == F.octet_length("_text")
    cut = texts.select(
        *texts.columns[:3],
        F.when(plain, F.col("_text")).alias("_ascii"),
        F.when(~plain, tokens(F.col("_text"))).alias("_tokens"),
    )
    return cut.mapInArrow(summed, ", ".join([*kept, "token string", "n bigint", *[f"{k} double" for k in ks]]))


# --- pyspark.ml models -----------------------------------------------------------


def _estimator(kind: str, n_classes: int, n_features: int, seed: int):
    columns = dict(featuresCol="features", labelCol="label")
    if kind == "logistic":
        return LogisticRegression(**columns, maxIter=20, regParam=0.01)
    if kind == "forest":
        return RandomForestClassifier(**columns, numTrees=20, maxDepth=5, seed=seed)
    if kind == "mlp":
        layers = [n_features, max(8, 2 * n_classes), n_classes]
        return MultilayerPerceptronClassifier(**columns, layers=layers, maxIter=40, seed=seed)
    if kind == "boosting":
        trees = GBTClassifier(**columns, maxIter=5, maxDepth=3, seed=seed)
        return trees if n_classes == 2 else OneVsRest(classifier=trees, **columns)
    raise ValueError(f"unknown scorer {kind!r}")


def fit_scorer(
    df: DataFrame,
    kind: str,
    n_classes: int,
    features: str = "features",
    y: str = "y",
    n_features: int | None = None,
    seed: int = 0,
) -> PipelineModel:
    """Fit on the labelled rows. ``kind``: logistic, forest, mlp or boosting."""
    rows = df.filter(F.col(y).isNotNull()).select(
        F.col(features).alias("features"), F.col(y).cast("double").alias("label")
    )
    if kind == "mlp" and n_features is None:
        n_features = rows.first()["features"].size
    fitted = Pipeline(stages=[_estimator(kind, n_classes, n_features or 0, seed)]).fit(rows)
    # a fitted model holds its training summary, and so the session; a stored one doesn't
    path = shared_folder(df.sparkSession)
    fitted.save(path)
    return PipelineModel.load(path)


def score_with(
    model: PipelineModel,
    df: DataFrame,
    n_classes: int,
    features: str = "features",
    candidate: str = "",
    keep: Sequence[str] = ("id",),
) -> DataFrame:
    """(keep.., candidate, probs). Raw scores of one-vs-rest models go through a
    softmax; classes the model has not seen get 0."""
    scored = model.transform(df.withColumn("features", F.col(features)))
    if "probability" in scored.columns:
        raw = vector_to_array("probability")
        probs = [F.coalesce(F.get(raw, F.lit(c)), F.lit(0.0)) for c in range(n_classes)]
    else:
        raw = vector_to_array("rawPrediction")
        missing = F.lit(float("-inf"))
        probs = softmax([F.coalesce(F.get(raw, F.lit(c)), missing) for c in range(n_classes)])
    return scored.select(
        *keep, F.lit(candidate).alias("candidate"), F.array(*probs).alias("probs")
    )


def ml_oof_scores(
    df: DataFrame,
    kind: str,
    k: int,
    n_classes: int,
    fold: str = "fold",
    features: str = "features",
    keep: Sequence[str] = ("id", "y", "fold"),
    n_features: int | None = None,
    seed: int = 0,
) -> DataFrame:
    """Out-of-fold scores of one model family: k fits. Boosting of more than two classes
    grows its trees on the softmax loss (``boosting``); the others are Spark's models."""

    def fit(train: DataFrame):
        if kind == "boosting" and n_classes > 2:
            size = n_features or train.first()[features].size
            made = boosting.fit_boosted(
                train.withColumn("_x", vector_to_array(features)), n_classes, size, x="_x", rounds=5, depth=3
            )
            return lambda test: boosting.boosted_scores(
                test.withColumn("_x", vector_to_array(features)), made, "_x", keep, kind
            )
        model = fit_scorer(
            train, kind, n_classes, features, n_features=n_features, seed=seed
        )
        return lambda test: score_with(model, test, n_classes, features, kind, keep)

    return oof(df, k, fit, fold)


def stack_scores(
    wide: DataFrame,
    candidates: Sequence[str],
    k: int,
    n_classes: int,
    keep: Sequence[str] = ("id", "y", "fold"),
    seed: int = 0,
) -> DataFrame:
    """Fusion by a small perceptron over the candidates' out-of-fold scores, itself
    scored out of fold: (keep.., candidate, probs, y_hat)."""
    rows = settle(wide.select(*keep, *candidates))
    rows = rows.withColumn(
        "features", array_to_vector(F.concat(*[F.col(c) for c in candidates]))
    )
    scored = ml_oof_scores(
        rows,
        "mlp",
        k,
        n_classes,
        keep=keep,
        n_features=n_classes * len(candidates),
        seed=seed,
    )
    return scored.withColumn("candidate", F.lit("stack")).withColumn(
        "y_hat", argmax_class(F.col("probs"), n_classes)
    )


def save_scorer(model: PipelineModel, path: str) -> None:
    model.save(path)


def load_scorer(path: str) -> PipelineModel:
    return PipelineModel.load(path)

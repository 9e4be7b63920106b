"""Queries by name: the operators over the given tables."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfold.functions.scores import argmax_class, gated_decide, max_prob
from tallyfold.functions.text import pattern_key, tokens
from tallyfold.operators import (
    align,
    boosting,
    byte_features,
    curves,
    decisions,
    ensemble,
    folds,
    fusion,
    keys,
    log_features,
    manifests,
    metrics,
    registry,
    resampling,
    scorers,
    sessions,
    submissions,
    tabular,
    text_features,
)
from tallyfold.operators import drift
from tallyfold.operators import trees as folders
from tallyfold.plans import selection
from tallyfold.plans import tables as t
from tallyfold.sources import files as trees
from tallyfold.sources import run_log
from tallyfold.sources import submission as files
from tallyfold.sources.shared import settle, shared_folder

K = t.VECTOR_CLASSES
BANDS = (0.112, 0.12)
GRID = (0.05, 0.08, 0.1, 0.2, 0.3, 0.32, 0.33, 0.34, 0.35, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)


def r6(column: str | Column, name: str | None = None) -> Column:
    col = F.col(column) if isinstance(column, str) else column
    return F.round(col, 6).alias(name or column)


# --- out-of-fold evaluation -------------------------------------------------------


def oof_macro_f1(spark: SparkSession, sf: str) -> DataFrame:
    conf = keys.lookup_confusion(
        t.orders(spark, sf), "key", "y", "fold", t.STATUSES, t.FOLDS
    )
    return metrics.macro_f1_of(conf, t.STATUSES).select("n_rows", "n_classes", r6("macro_f1"))


def confusion(spark, sf):
    return metrics.confusion(t.line_predictions(spark, sf))


def macro_f1_closed(spark, sf):
    out = metrics.macro_f1(t.line_predictions(spark, sf), [*t.FLAGS, "X"])
    return out.select("n_rows", "n_classes", r6("macro_f1"))


def class_f1(spark, sf):
    conf = metrics.confusion(t.line_predictions(spark, sf))
    out = metrics.class_f1(conf, [*t.FLAGS, "X"])
    return out.select("class", "tp", "n_true", "n_pred", r6("f1"))


def macro_f1_positive(spark, sf):
    out = metrics.macro_f1_positive(t.line_predictions(spark, sf), "N")
    return out.select("n_rows", "n_classes", r6("macro_f1", "macro_f1_positive_rows"))


def accuracy(spark, sf):
    return metrics.accuracy(t.line_predictions(spark, sf)).select("n_rows", r6("accuracy"))


def weighted_f1(spark, sf):
    out = metrics.weighted_f1(t.line_predictions(spark, sf))
    return out.select("n_rows", r6("weighted_f1"))


def many_class_confusion(spark, sf):
    return keys.lookup_confusion(
        t.many_classes(spark, sf), "key", "y", "fold", list(range(t.MANY)), t.FOLDS
    )


def class_delta(spark, sf):
    return metrics.class_delta(
        t.order_predictions(spark, sf, "coarse"), t.order_predictions(spark, sf, "key")
    )


def flip_matrix(spark, sf):
    return metrics.flip_matrix(
        t.order_predictions(spark, sf, "coarse"), t.order_predictions(spark, sf, "key")
    )


def _resampled(spark, sf):
    coarse, fine = (t.order_predictions(spark, sf, key) for key in ("coarse", "key"))
    return resampling.bootstrap_pair(coarse, fine, t.STATUSES, 25)


def bootstrap_replicates(spark, sf):
    out = _resampled(spark, sf)
    return out.select("replicate", *[r6(c) for c in out.columns[1:]])


def bootstrap_interval(spark, sf):
    out = resampling.interval(_resampled(spark, sf))
    return out.select("n_replicates", *[r6(c) for c in out.columns[1:]])


def _line_submission(spark, sf):
    return t.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("y_hat")
    )


def _check(spark, sf):
    expected = t.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    return submissions.check_submission(_line_submission(spark, sf), expected, ["A", "N"])


def submission_check(spark, sf):
    return _check(spark, sf)


def validation_report(spark, sf):
    checks = _check(spark, sf).drop("valid")
    scores = macro_f1_closed(spark, sf).select("macro_f1")
    path = shared_folder(spark)
    files.write_report(submissions.validation_report(checks, scores), path)
    return files.read_report(spark, path)


def submission_roundtrip(spark, sf):
    path = shared_folder(spark)
    files.write_submission(t.order_predictions(spark, sf), path)
    return files.read_submission(spark, path)


# --- folds, keys, features --------------------------------------------------------


def fold_hash(spark, sf):
    docs = folds.assign_folds(t.spread_out(t.texts(spark, sf), "id"), t.FOLDS, ["text"])
    return docs.select(F.col("id").alias("doc_id"), "fold")


def fold_stratified(spark, sf):
    rows = t.labelled_texts(spark, sf).drop("fold")
    out = folds.stratified_folds(rows, t.FOLDS, "text", "y", "id")
    return out.select(F.col("id").alias("doc_id"), "fold")


def smoke_sample(spark, sf):
    rows = t.orders(spark, sf).select("id", "y")
    return folds.smoke_sample(rows, 5, "y", "id")


def _key_features(rows: DataFrame) -> DataFrame:
    return keys.exact_key_features(rows, "key", "y", "fold", t.STATUSES, "id", t.FOLDS)


def exact_key_features(spark, sf):
    return _key_features(t.orders(spark, sf)).select(
        "id", r6("key_log_n"), r6("key_share"), "key_n_classes", "key_majority", "key_unseen"
    )


def pattern_lookup_oof(spark, sf):
    rows = t.labelled_texts(spark, sf).withColumn("key", pattern_key(F.col("text")))
    out = keys.lookup_candidate(rows.drop("text"), "key", "y", "fold", [0, 1], "id", t.FOLDS)
    return out.select(
        F.col("id").alias("doc_id"), "y", "y_hat", r6(F.col("probs")[1], "p1")
    )


ALIGNED = T.StructType(
    [
        T.StructField("o_orderkey", T.LongType()),
        T.StructField("o_totalprice", T.DoubleType()),
        T.StructField("o_custkey", T.DoubleType()),
        T.StructField("o_orderpriority", T.DoubleType()),
        T.StructField("key_extra", T.DoubleType()),
        T.StructField("o_orderstatus", T.StringType()),
    ]
)


def feature_align(spark, sf):
    out = align.align(t.table(spark, sf, "orders"), ALIGNED, fill=-1.0)
    return align.require_schema(out, ALIGNED)


def schema_diff(spark, sf):
    teacher = t.table(spark, sf, "documents").join(t.table(spark, sf, "labels"), "doc_id", "left")
    student = teacher.select(
        "doc_id",
        F.col("n_chars").cast("double").alias("n_chars"),
        "toxic",
        F.nullif("lang", F.lit("en")).alias("lang"),
        F.length("text").alias("n_points"),
    )
    return align.schema_diff(teacher, student)


def feature_mismatch(spark, sf):
    names = ["key_log_n", "key_share", "key_n_classes", "key_unseen"]
    teacher = _key_features(t.orders(spark, sf)).select("id", *names)
    other = _key_features(t.orders(spark, sf, seed="s"))
    student = other.select(
        "id",
        "key_log_n",
        "key_share",
        F.col("key_n_classes").cast("double").alias("key_n_classes"),
        F.lit(0).alias("key_new"),
    )
    out = align.compare_features(teacher, student, "id")
    return out.select(
        "column", "status", "n_rows", "n_mismatch", r6("mismatch_rate"), r6("max_abs_diff")
    )


def tta_windows(spark, sf):
    docs = t.spread_out(t.texts(spark, sf), "id")
    views = text_features.windows(docs, ["id"], n=3)
    scored = views.withColumn(
        "score",
        F.try_divide(F.regexp_count("view_text", F.lit("[aeiou]")), F.length("view_text")),
    )
    out = ensemble.mean_over_views(scored, ["id"], ["score"])
    return out.select(F.col("id").alias("doc_id"), "n_views", r6("score", "mean_score"))


def text_entropy(spark, sf):
    docs = t.spread_out(t.texts(spark, sf), "id")
    out = text_features.char_entropy(docs, "id")
    return out.select(F.col("id").alias("doc_id"), "n_chars", "n_distinct", r6("entropy"))


def text_counts(spark, sf):
    docs = t.spread_out(t.texts(spark, sf), "id")
    out = text_features.text_counts(docs)
    return out.select(
        F.col("id").alias("doc_id"),
        "n_length",
        "n_tokens",
        "n_symbols",
        "n_urls",
        "n_base64",
        r6("symbol_ratio"),
    )


def byte_feature_rows(spark, sf):
    docs = t.spread_out(t.texts(spark, sf), "id")
    content = docs.select("id", F.encode("text", "UTF-8").alias("content"))
    out = byte_features.byte_features(content, "id")
    return out.select(
        F.col("id").alias("doc_id"),
        "size",
        "sha256",
        F.size(F.filter("histogram", lambda n: n > 0)).alias("n_distinct"),
        r6("entropy"),
        r6("max_window_entropy"),
        r6("mean_window_entropy"),
    )


def log_hour_counts(spark, sf):
    return log_features.log_counts(t.events(spark, sf), "user_id")


def log_zscore(spark, sf):
    rows = t.events(spark, sf).select("event_id", "event_type", "value")
    out = log_features.zscore(rows, "value", "event_type", "event_id")
    return out.select("event_id", r6("z"))


def log_rare_template(spark, sf):
    message = F.concat_ws(" ", "event_type", F.get_json_object("props", "$.k"))
    out = log_features.rare_template(
        t.events(spark, sf), message, 0.05, ["user_id"], "event_id"
    )
    return out.select("event_id", "template", "template_n", r6("template_share"), "is_rare")


def session_surprise(spark, sf):
    out = sessions.session_surprise(t.events(spark, sf), "user_id", "event_type", "12 hours")
    return out.select("user_id", "session", "started", "ended", "n_events", r6("surprise"))


def pattern_backoff(spark, sf):
    rows = t.labelled_texts(spark, sf).withColumn("tokens", tokens(F.col("text"))).drop("text")
    out = keys.backoff_scores(rows, "tokens", "y", "fold", t.QUALITY_CLASSES, "id", t.FOLDS)
    return out.select(F.col("id").alias("doc_id"), "y", "level", r6(F.col("probs")[1], "p1"))


def tabular_vector(spark, sf):
    rows = t.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), "o_totalprice", "o_orderpriority", "o_orderstatus"
    )
    out = tabular.tabular_vector(rows, ["o_totalprice"], ["o_orderpriority"])
    x = vector_to_array("features")
    return out.select("id", *[r6(x[i], f"f{i}") for i in range(6)])


# --- scorers and ensembles --------------------------------------------------------


def _block_scores(spark, sf, seeds=t.SEEDS, samples=t.vectors) -> DataFrame:
    rows = samples(spark, sf)
    model = scorers.fit_centroids(rows, "x", "y", "fold", K)
    return scorers.score_centroids(
        rows, model, "x", ["id", "y"], "fold", t.block_candidates(seeds)
    )


def _wide(spark, sf) -> DataFrame:
    scores = _block_scores(spark, sf, seeds=(t.WHOLE,))
    return ensemble.wide_scores(scores, t.BLOCKS, keep=["y"])


def centroid_scores(spark, sf):
    rows = t.vectors(spark, sf)
    model = scorers.fit_centroids(rows, "x", "y", "fold", K)
    out = scorers.score_centroids(
        rows, model, "x", ["id", "fold"], "fold", [("all", 0, range(64))]
    )
    return out.select("id", "fold", F.posexplode("probs").alias("class", "p")).select(
        "id", "fold", "class", r6("p")
    )


def nb_scores(spark, sf):
    return _naive_bayes(spark, sf).select(
        F.col("id").alias("doc_id"), "fold", "y", r6(F.col("probs")[1], "p1")
    )


def _naive_bayes(spark, sf) -> DataFrame:
    rows = t.labelled_texts(spark, sf)
    return scorers.naive_bayes_scores(
        rows, "id", "text", "y", "fold", t.QUALITY_CLASSES, t.FOLDS
    )


def _score_check(scored: DataFrame, learns: Column) -> DataFrame:
    """One row for each candidate: how many rows and ids were scored, how many scores are
    missing or don't add up to 1, and whether the model has learnt anything."""
    total = F.aggregate("probs", F.lit(0.0), lambda a, p: a + p)
    return scored.groupBy("candidate").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct("id").alias("n_ids"),
        F.count_if(F.col("probs").isNull() | F.exists("probs", lambda p: p.isNull() | F.isnan(p))).alias("n_null"),
        F.count_if(F.abs(total - 1) > 1e-6).alias("n_bad_sum"),
        learns.alias("learns"),
    )


def _accuracy(n_classes: int) -> Column:
    hit = argmax_class(F.col("probs"), n_classes).eqNullSafe(F.col("y"))
    return F.avg(F.when(F.col("y").isNotNull(), hit.cast("double")))


def ml_scores(spark, sf):
    rows = settle(folds.assign_folds(t.halves(spark, sf), 2, ["id"]))
    rows = rows.withColumn("features", array_to_vector(F.col("x").cast("array<double>")))
    parts = [
        scorers.ml_oof_scores(rows, kind, 2, 2, n_features=64)
        for kind in ("logistic", "forest", "mlp", "boosting")
    ]
    return _score_check(reduce(DataFrame.unionByName, parts), _accuracy(2) > 0.6)


def text_ml_scores(spark, sf):
    rows = folds.assign_folds(t.labelled_texts(spark, sf).drop("fold"), 2, ["text"])
    hashed = text_features.hashed_tokens(rows, dims=1 << 12).select("id", "y", "fold", "features")
    scored = scorers.ml_oof_scores(settle(hashed), "logistic", 2, t.QUALITY_CLASSES)
    p1 = F.get("probs", F.lit(1))
    return _score_check(scored, F.max(p1) - F.min(p1) > 0.01)


def tabular_ml_scores(spark, sf):
    """Scaler, categories and model are all fitted without the fold that is scored. The class
    is told by priority and month, so that a model can learn it."""
    rows = t.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        "o_custkey",
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), 0)
        .when(F.month("o_orderdate") <= 6, 1)
        .otherwise(2)
        .alias("y"),
        "o_totalprice",
        "o_orderpriority",
        F.month("o_orderdate").alias("o_month"),
    )
    rows = settle(folds.assign_folds(rows, 2, ["o_custkey"]))

    def fit(train):
        made = tabular.fit_tabular(train, ["o_totalprice", "o_month"], ["o_orderpriority"])
        model = scorers.fit_scorer(made.transform(train), "logistic", len(t.STATUSES))

        def score(test):
            return scorers.score_with(
                model, made.transform(test), len(t.STATUSES), candidate="logistic", keep=["id", "y"]
            )

        return score

    return _score_check(folds.oof(rows, 2, fit), _accuracy(len(t.STATUSES)) > 0.6)


def boosted_splits(spark, sf):
    rows = t.vectors(spark, sf)
    out = boosting.first_splits(rows, K, t.DIMENSIONS, depth=3, n_bins=16)
    return out.withColumn("threshold", r6("threshold")).withColumn("gain", r6("gain"))


def boosted_scores(spark, sf):
    """Two rounds of ten trees, fitted without fold 0."""
    rows = t.vectors(spark, sf)
    model = boosting.fit_boosted(
        rows.filter(F.col("fold") > 0), K, t.DIMENSIONS, rounds=2, depth=3, n_bins=16
    )
    out = boosting.boosted_scores(rows, model, keep=["id"])
    return out.select(
        "id",
        argmax_class(F.col("probs"), K).alias("y_hat"),
        r6(max_prob(F.col("probs")), "confidence"),
    )


def model_reload_same_scores(spark, sf):
    rows = t.vectors(spark, sf).withColumn(
        "features", array_to_vector(F.col("x").cast("array<double>"))
    )
    model = scorers.fit_scorer(rows, "forest", K)
    path = shared_folder(spark)
    scorers.save_scorer(model, path)
    again = scorers.load_scorer(path)
    first = scorers.score_with(model, rows, K, keep=["id", "features"])
    both = scorers.score_with(
        again, first.withColumnRenamed("probs", "before"), K, keep=["id", "before"]
    )
    return both.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum((F.col("before") != F.col("probs")).cast("bigint")).alias("n_different"),
    )


def argmax_dimension(spark, sf):
    rows = t.vectors(spark, sf)
    return rows.select("id", argmax_class(F.col("x").cast("array<double>"), 64).alias("y_hat"))


def seed_ensemble(spark, sf):
    out = ensemble.mean_over_seeds(_block_scores(spark, sf), K)
    return out.select(
        "id",
        "candidate",
        argmax_class(F.col("probs"), K).alias("y_hat"),
        r6(max_prob(F.col("probs")), "confidence"),
    )


def metric_by_seed(spark, sf):
    rows = t.vectors(spark, sf)
    model = scorers.fit_centroids(rows, "x", "y", "fold", K)
    scores = scorers.score_centroids(
        rows, model, "x", ["id", "y"], "fold", t.seeded_candidates()
    )
    pred = scores.withColumn("y_hat", argmax_class(F.col("probs"), K))
    out = metrics.metric_by_seed(pred, list(range(K)))
    return out.select("n_seeds", *[r6(c) for c in out.columns[1:]])


def adaptive_ensemble(spark, sf):
    scores = settle(_block_scores(spark, sf))
    pred = scores.withColumn("y_hat", argmax_class(F.col("probs"), K))
    weights = ensemble.oof_weights(pred, list(range(K)), ["candidate", "seed"])
    out = ensemble.weighted_ensemble(scores, weights, ["candidate", "seed"], K)
    return out.select(
        "id",
        argmax_class(F.col("probs"), K).alias("y_hat"),
        r6(max_prob(F.col("probs")), "confidence"),
    )


def simplex_fusion(spark, sf):
    out = ensemble.simplex_search(_wide(spark, sf), t.BLOCKS, K, steps=10, top=5)
    return out.select("rank", *[f"w_{b}" for b in t.BLOCKS], r6("macro_f1"))


def simplex_line_search(spark, sf):
    """From the even mixture towards each candidate."""
    scores = _block_scores(spark, sf, (t.WHOLE,), t.corners)
    wide = settle(ensemble.wide_scores(scores, t.BLOCKS, keep=["y"]))
    out = fusion.line_search(wide, t.BLOCKS, [0.25] * 4, K)
    return out.select("towards", "n_intervals", r6("t"), r6("macro_f1"), r6("start_f1"))


def greedy_ensemble(spark, sf):
    out = fusion.greedy_selection(_block_scores(spark, sf, samples=t.corners), K, steps=6)
    return out.select("step", "candidate", F.col("seed").cast("int").alias("seed"), r6("macro_f1"))


def stack_fusion(spark, sf):
    scores = _block_scores(spark, sf, (t.WHOLE,), t.corners)
    rows = folds.assign_folds(ensemble.wide_scores(scores, t.BLOCKS, keep=["y"]), 2, ["id"])
    out = scorers.stack_scores(rows, t.BLOCKS, 2, K)
    return _score_check(out, _accuracy(K) > 2 / K)


def _even_mixture(spark, sf) -> DataFrame:
    return settle(
        selection.candidate_predictions(_wide(spark, sf), t.BLOCKS, [0.25] * 4, K)
    )


def class_guard(spark, sf):
    out = selection.guard(_even_mixture(spark, sf), "block0", 1, 0.8, 1.25)
    return out.select("candidate", "n_base", "n_candidate", r6("ratio"), "passes")


def candidate_select(spark, sf):
    pred = _even_mixture(spark, sf)
    scores = metrics.macro_f1(pred, list(range(K)), by=["candidate"])
    out = ensemble.select_candidate(scores, selection.guard(pred, "block0", 1, 0.8, 1.25))
    return out.select("candidate", r6("macro_f1"), "passes", "rank", "selected")


def selected_submission(spark, sf):
    wide = _wide(spark, sf)
    return selection.selected_submission(wide, t.BLOCKS, K, "block0", 1, 0.8, 1.25)


# --- decisions and pseudo-labels --------------------------------------------------


def threshold_sweep(spark, sf):
    rows = t.orders(spark, sf).withColumn("y", (F.col("y") == "F").cast("int"))
    scored = keys.exact_key_features(rows, "key", "y", "fold", [0, 1], "id", t.FOLDS)
    out = decisions.threshold_sweep(scored, GRID, p="key_share")
    ratios = ("precision", "recall", "f1", "accuracy")
    return out.select("threshold", "tp", "fp", "fn", "tn", *[r6(c) for c in ratios], "best")


def _shares(spark, sf) -> DataFrame:
    """Orders with their key's share of class F in the other folds as a score."""
    rows = t.orders(spark, sf).withColumn("y", (F.col("y") == "F").cast("int"))
    scored = keys.lookup_candidate(rows, "key", "y", "fold", [0, 1], "id", t.FOLDS)
    return scored.select("id", "y", "fold", F.col("probs")[1].alias("p"))


def threshold_curve(spark, sf):
    out = curves.threshold_curve(_shares(spark, sf))
    return out.select(r6("threshold"), "tp", "fp", "fn", "tn", r6("precision"), r6("recall"), r6("f1"))


def threshold_summary(spark, sf):
    out = curves.threshold_summary(_shares(spark, sf))
    return out.select("n_thresholds", *[r6(c) for c in out.columns[1:]])


def calibrated_scores(spark, sf):
    out = curves.calibrated_oof(_shares(spark, sf), t.FOLDS)
    return out.select("id", "fold", "y", r6("p"), r6("calibrated"))


def gated_decision(spark, sf):
    first = lambda c: F.get(c, F.lit(0))
    p_label = 1.0 - (first("block0") + first("block1")) / 2
    probs = F.zip_with("block2", "block3", lambda a, b: (a + b) / 2)
    return _wide(spark, sf).select("id", gated_decide(p_label, probs, 0.9, K).alias("y_hat"))


def _pool(spark, sf):
    return _naive_bayes(spark, sf).filter(F.col("y").isNull())


def pseudo_label(spark, sf):
    out = decisions.pseudo_label(_pool(spark, sf), 0.7, t.QUALITY_CLASSES)
    return out.select(F.col("id").alias("doc_id"), "y_hat", r6("confidence"))


def pseudo_label_capped(spark, sf):
    out = decisions.pseudo_label(_pool(spark, sf), 0.7, t.QUALITY_CLASSES, per_class_cap=50)
    return out.select(F.col("id").alias("doc_id"), "y_hat", r6("confidence"))


def pseudo_coverage(spark, sf):
    out = decisions.pseudo_coverage(_pool(spark, sf), [0.5, 0.7, 0.9, 0.99], t.QUALITY_CLASSES)
    return out.select("threshold", "pool", "selected", r6("coverage"))


def confidence_bands(spark, sf):
    rows = t.vectors(spark, sf)
    model = scorers.fit_centroids(rows, "x", "y", "fold", K)
    scored = scorers.score_centroids(
        rows, model, "x", ["id", "y"], "fold", [("all", 0, range(64))]
    )
    out = decisions.confidence_bands(scored, BANDS, K)
    return out.select("band", "lower", "n", "n_right", r6("precision"))


def pseudo_union(spark, sf):
    scores = settle(_naive_bayes(spark, sf))
    labelled = scores.filter(F.col("y").isNotNull()).select("id", "y")
    sure = decisions.pseudo_label(scores, 0.7, t.QUALITY_CLASSES)
    return decisions.with_pseudo(labelled, sure, 0.5)


# --- registry, logs, files --------------------------------------------------------


def registry_latest(spark, sf):
    return registry.latest_version(t.registry(spark, sf))


def version_delta(spark, sf):
    out = registry.version_delta(t.registry(spark, sf))
    return out.select(
        "project",
        "metric",
        "version",
        "score",
        r6("delta_points"),
        "best_before",
        "regression",
    )


def score_gap(spark, sf):
    out = registry.score_gap(t.registry(spark, sf), "local", "platform")
    return out.select("project", "version", "local_score", "platform_score", r6("gap_points"))


def run_log_parse(spark, sf):
    out = run_log.parse_run_log(t.run_log(spark, sf))
    return out.select(
        "ts",
        "project",
        "version",
        "selected",
        F.col("metrics")["macro_f1"].alias("macro_f1"),
        F.size("metrics").alias("n_metrics"),
    )


def index_vs_log(spark, sf):
    logged = run_log.parse_run_log(t.run_log(spark, sf))
    return registry.index_vs_log(t.registry(spark, sf), logged)


def record_check(spark, sf):
    return registry.check_records(t.records(spark, sf), "id")


def leftover_files(spark, sf):
    rows = t.result_files(spark, sf)
    current = rows.filter(F.col("flag") == "N").select("project", "version")
    return manifests.find_leftovers(rows, current)


def manifest_totals(spark, sf):
    docs = t.table(spark, sf, "documents")
    return manifests.totals(docs.select(F.col("n_chars").alias("length")))


def tree_totals(spark, sf):
    root = t.document_files(spark, sf)
    return manifests.totals(trees.manifest(spark, root))


def file_byte_features(spark, sf):
    files_of = trees.contents(spark, t.document_files(spark, sf))
    out = byte_features.byte_features(files_of)
    return out.select(
        F.regexp_extract("path", r"([0-9]+)$", 1).cast("bigint").alias("doc_id"),
        "size",
        "sha256",
        F.size(F.filter("histogram", lambda n: n > 0)).alias("n_distinct"),
        r6("entropy"),
    )


def manifest_diff(spark, sf):
    return manifests.reconcile(*t.trees(spark, sf))


def moved_files(spark, sf):
    return folders.moves(*t.hashed_trees(spark, sf), "sha")


def folder_totals(spark, sf):
    return folders.folder_totals(t.hashed_trees(spark, sf)[0], "sha")


def folder_diff(spark, sf):
    return folders.folder_diff(*t.hashed_trees(spark, sf), "sha")


def column_drift(spark, sf):
    """Exact drift of open and returned line items, and whether sketches agree within their error."""
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    lines = t.table(spark, sf, "lineitem")
    kept, returned = lines.filter("l_returnflag <> 'R'"), lines.filter("l_returnflag = 'R'")
    exact = drift.column_drift(kept, returned, names)
    read = drift.sketched_ks(drift.column_sketches(kept, names), drift.column_sketches(returned, names))
    near = read.select("column", F.col("ks").alias("read"), "error")
    return exact.join(near, "column").select(
        "column", "n_a", "n_b", r6("ks"), r6("psi"), (F.abs(F.col("read") - F.col("ks")) <= F.col("error")).alias("sketch_agrees")
    )


QUERIES = {
    f.__name__: f
    for f in (
        oof_macro_f1,
        confusion,
        macro_f1_closed,
        class_f1,
        macro_f1_positive,
        accuracy,
        weighted_f1,
        many_class_confusion,
        class_delta,
        flip_matrix,
        bootstrap_replicates,
        bootstrap_interval,
        submission_check,
        validation_report,
        submission_roundtrip,
        fold_hash,
        fold_stratified,
        smoke_sample,
        exact_key_features,
        pattern_lookup_oof,
        feature_align,
        schema_diff,
        feature_mismatch,
        tta_windows,
        text_entropy,
        text_counts,
        log_hour_counts,
        log_zscore,
        log_rare_template,
        session_surprise,
        pattern_backoff,
        tabular_vector,
        centroid_scores,
        nb_scores,
        ml_scores,
        text_ml_scores,
        tabular_ml_scores,
        boosted_splits,
        boosted_scores,
        model_reload_same_scores,
        seed_ensemble,
        metric_by_seed,
        adaptive_ensemble,
        simplex_fusion,
        simplex_line_search,
        greedy_ensemble,
        stack_fusion,
        class_guard,
        candidate_select,
        selected_submission,
        threshold_sweep,
        threshold_curve,
        threshold_summary,
        calibrated_scores,
        gated_decision,
        pseudo_label,
        pseudo_label_capped,
        pseudo_coverage,
        confidence_bands,
        pseudo_union,
        registry_latest,
        version_delta,
        score_gap,
        run_log_parse,
        index_vs_log,
        record_check,
        leftover_files,
        manifest_totals,
        tree_totals,
        file_byte_features,
        manifest_diff,
        moved_files,
        folder_totals,
        folder_diff,
        column_drift,
    )
} | {"argmax_class": argmax_dimension, "byte_features": byte_feature_rows}

"""Exact-key lookups that never see the row's own fold.

One grouped pass counts classes per (key, fold). What a row may use is the total
of its key less its own fold's part. Unlabelled rows are in no fold and may use
everything. A key with nothing left, and a null key, falls back to the class
shares of the other folds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.functions.scores import UNROLL_LIMIT, argmax_of
from tallyfold.operators.skew import key_table, lookup_join

NO_FOLD = -1
MAX_FOLDS = 1024
WIDE_COLUMNS = 64


def own_fold(y: str, fold: str, n_folds: int) -> Column:
    """Fold of a labelled row, NO_FOLD of an unlabelled one. Nothing else can occur,
    so a table with one row per fold has at most n_folds + 1 rows."""
    return (
        F.when(F.col(y).isNull(), F.lit(NO_FOLD))
        .when(F.col(fold).between(0, n_folds - 1), F.col(fold))
        .otherwise(F.raise_error(F.lit(f"folds must be 0 .. {n_folds - 1}")).cast("int"))
    )


def fold_counts(
    df: DataFrame,
    key: str,
    y: str,
    fold: str,
    classes: Sequence,
    n_folds: int,
    wide_columns: int = WIDE_COLUMNS,
) -> DataFrame:
    """(key, _fold, n_rows, n0 .. nK-1, l0 .. lK-1): rows of each class in this fold
    (n) and in the key's other folds (l). A key has at most one row per fold.

    Rows are reduced to counts per (key, fold, class) in the task that reads them and
    then brought together per key: side by side with few folds and classes, by a
    window over the key's folds with many.
    """
    if not 0 < n_folds <= MAX_FOLDS:
        raise ValueError(f"{n_folds} folds, at most {MAX_FOLDS} are supported")
    k = range(len(classes))
    rows = df.withColumn("_fold", own_fold(y, fold, n_folds))
    if (n_folds + 1) * (len(classes) + 1) > wide_columns:
        own = rows.groupBy(key, "_fold").agg(
            F.count(F.lit(1)).alias("n_rows"),
            *[F.count_if(F.col(y) == F.lit(c)).alias(f"n{i}") for i, c in enumerate(classes)],
        )
        same_key = Window.partitionBy(key)
        others = [F.sum(f"n{i}").over(same_key) - F.col(f"n{i}") for i in k]
        return own.select(
            "*",
            *[
                F.when(F.col(key).isNotNull(), c).otherwise(F.lit(0)).alias(f"l{i}")
                for i, c in enumerate(others)
            ],
        )

    # one small number says which count a row adds to
    width = len(classes) + 1
    which = F.lit(len(classes))
    for i in reversed(k):
        which = F.when(F.col(y) == F.lit(classes[i]), F.lit(i)).otherwise(which)
    cells = (
        rows.select(key, ((F.col("_fold") + 1) * width + which).alias("_cell"))
        .groupBy(key, "_cell")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    count = [[f"c{f * width + i}" for i in range(width)] for f in range(n_folds + 1)]
    total = [" + ".join(own[i] for own in count) for i in k]
    parts = []
    for f, own in enumerate(count):
        fields = [f"{f + NO_FOLD} as _fold", f"{' + '.join(own)} as n_rows"]
        fields += [f"{own[i]} as n{i}" for i in k]
        fields += [f"if(_keyed, {total[i]} - {own[i]}, 0L) as l{i}" for i in k]
        parts.append(f"struct({', '.join(fields)})")
    return (
        cells.groupBy(key)
        .agg(*[F.expr(f"sum(if(_cell = {c[1:]}, _n, 0L)) as {c}") for own in count for c in own])
        .withColumn("_keyed", F.col(key).isNotNull())
        .select(key, F.expr(f"inline(array({', '.join(parts)}))"))
        .filter(F.col("n_rows") > 0)
    )


def prior_counts(counts: DataFrame, n_classes: int) -> DataFrame:
    """(_fold, p0 .. pK-1): class totals of all other folds, one row per fold.
    Small by construction: at most MAX_FOLDS + 1 rows."""
    per_fold = counts.groupBy("_fold").agg(
        *[F.sum(f"n{i}").alias(f"n{i}") for i in range(n_classes)]
    )
    everything = Window.partitionBy(F.lit(0))
    return per_fold.select(
        "_fold",
        *[
            (F.sum(f"n{i}").over(everything) - F.col(f"n{i}")).alias(f"p{i}")
            for i in range(n_classes)
        ],
    )


def _sum(columns: Sequence[Column]) -> Column:
    return sum(columns[1:], columns[0])


def _usable(joined: DataFrame, n_classes: int) -> DataFrame:
    """Add _left, the key's counts; _n, their sum; _use, the counts to decide by: the key's
    or else the prior's; _total, their sum; _best, the class they name. Each in a step of its
    own, so that no expression holds another one once for every class."""
    k = range(n_classes)
    left = joined.withColumn("_left", F.array(*[F.coalesce(F.col(f"l{i}"), F.lit(0)) for i in k]))
    left = left.withColumn("_n", _sum([F.coalesce(F.col(f"l{i}"), F.lit(0)) for i in k]))
    prior = F.array(*[F.col(f"p{i}") for i in k])
    use = left.withColumn("_use", F.when(F.col("_n") > 0, F.col("_left")).otherwise(prior))
    if n_classes <= UNROLL_LIMIT:
        best = argmax_of([F.get("_use", F.lit(i)) for i in k], exact=True)
    else:
        ranked = F.transform("_use", lambda n, i: F.struct(n.alias("q"), (-i).alias("k")))
        top = F.array_max(ranked)
        best = F.when(top["q"].isNotNull(), -top["k"])
    total = F.when(F.col("_n") > 0, F.col("_n")).otherwise(_sum([F.col(f"p{i}") for i in k]))
    return use.withColumn("_total", total).withColumn("_best", best)


def _labelled(index: Column, classes: Sequence) -> Column:
    return F.get(F.array(*[F.lit(c) for c in classes]), index)


def _looked_up(
    df: DataFrame,
    key: str,
    y: str,
    fold: str,
    classes: Sequence,
    spread: str,
    n_folds: int,
) -> DataFrame:
    k = len(classes)
    counts = key_table(fold_counts(df, key, y, fold, classes, n_folds))
    others = counts.filter(F.col(key).isNotNull()).select(
        key, "_fold", "n_rows", *[f"l{i}" for i in range(k)]
    )
    rows = df.withColumn("_fold", own_fold(y, fold, n_folds))
    joined = lookup_join(rows, others, [key, "_fold"], [spread])
    return joined.join(F.broadcast(prior_counts(counts.table, k)), "_fold", "left")


def exact_key_features(
    df: DataFrame,
    key: str,
    y: str,
    fold: str,
    classes: Sequence,
    spread: str,
    n_folds: int,
) -> DataFrame:
    """Five columns about the row's key, seen from the other folds.

    key_log_n: log(1 + labelled rows); key_share: share of the second class when
    there are two, else of the top class; key_n_classes; key_majority; key_unseen.
    """
    k = len(classes)
    joined = _looked_up(df, key, y, fold, classes, spread, n_folds)
    total = F.col("_total")
    top = F.get("_use", F.lit(1)) if k == 2 else F.array_max("_use")
    return _usable(joined, k).select(
        *[F.col(c) for c in df.columns],
        F.log1p(F.col("_n").cast("double")).alias("key_log_n"),
        F.when(total > 0, top / total).alias("key_share"),
        F.size(F.filter("_left", lambda n: n > 0)).alias("key_n_classes"),
        _labelled(F.col("_best"), classes).alias("key_majority"),
        (F.col("_n") == 0).cast("int").alias("key_unseen"),
    )


def lookup_candidate(
    df: DataFrame,
    key: str,
    y: str,
    fold: str,
    classes: Sequence,
    spread: str,
    n_folds: int,
) -> DataFrame:
    """Predict by the row's key: adds ``probs`` (share of each class) and ``y_hat``."""
    joined = _looked_up(df, key, y, fold, classes, spread, n_folds)
    total = F.col("_total")
    return _usable(joined, len(classes)).select(
        *[F.col(c) for c in df.columns],
        F.when(total > 0, F.transform("_use", lambda n: n / total)).alias("probs"),
        _labelled(F.col("_best"), classes).alias("y_hat"),
    )


def lookup_confusion(
    df: DataFrame, key: str, y: str, fold: str, classes: Sequence, n_folds: int
) -> DataFrame:
    """Confusion table of ``lookup_candidate`` without joining back to the rows.

    All rows of a (key, fold) get one prediction, so the counts per (key, fold)
    already say how often each true class meets it. Only these counts are shuffled.
    A true class that isn't in ``classes`` is an error, raised when its rows are counted.
    """
    k = len(classes)
    counts = fold_counts(
        df.filter(F.col(y).isNotNull()), key, y, fold, classes, n_folds
    )
    joined = counts.join(F.broadcast(prior_counts(counts, k)), "_fold", "left")
    listed = _sum([F.col(f"n{i}") for i in range(k)])
    unlisted = F.raise_error(F.lit("a true class is not among the classes")).cast("int")
    sound = joined.withColumn("_best_of", F.when(F.col("n_rows") == listed, F.lit(0)).otherwise(unlisted))
    by_pred = (
        _usable(sound, k)
        .groupBy((F.col("_best") + F.col("_best_of")).alias("_p"))
        .agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in range(k)])
    )
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("y"), F.col(f"n{i}").alias("n"))
            for i, c in enumerate(classes)
        ]
    )
    return (
        by_pred.select(_labelled(F.col("_p"), classes).alias("y_hat"), F.inline(cells))
        .filter(F.col("n") > 0)
        .select("y", "y_hat", "n")
    )


def backoff_scores(
    df: DataFrame,
    tokens: str,
    y: str,
    fold: str,
    n_classes: int,
    id_col: str,
    n_folds: int,
    depth: int = 6,
    pull: float = 2.0,
) -> DataFrame:
    """(id, y, fold, level, probs): class shares of the longest token prefix that occurs with
    a label in other folds, each level drawn towards the one above it.

    Prefixes of 0 to ``depth`` tokens form a trie. At each level with labels left, the shares
    are (count + ``pull`` x share above) / (all + ``pull``); the root starts even. ``level`` is
    the length of the longest prefix used, -1 without any label. A null array has no tokens.
    An id's prefixes are at most depth + 1 rows; keys are joined as in every lookup here.
    """
    classes = list(range(n_classes))
    known = F.coalesce(F.col(tokens), F.array().cast("array<string>"))
    upto = F.sequence(F.lit(0), F.least(F.size(known), F.lit(depth)))
    rows = df.select(
        F.col(id_col).alias("id"),
        F.col(y).alias("y"),
        own_fold(y, fold, n_folds).alias("fold"),
        F.explode(upto).alias("level"),
        known.alias("_tokens"),
    ).select("id", "y", "fold", "level", F.concat_ws(" ", F.slice("_tokens", F.lit(1), F.col("level"))).alias("prefix"))
    # tokens have no blanks, so a prefix tells its length
    counted = key_table(fold_counts(rows, "prefix", "y", "fold", classes, n_folds))
    shares = counted.select("prefix", "_fold", "n_rows", *[f"l{c}" for c in classes])
    found = lookup_join(rows.withColumn("_fold", F.col("fold")), shares, ["prefix", "_fold"], ["id", "level"])
    counts = F.array(*[F.coalesce(F.col(f"l{c}"), F.lit(0)) for c in classes])
    by_id = found.groupBy("id", "y", "fold").agg(
        F.array_sort(F.collect_list(F.struct("level", counts.alias("counts")))).alias("levels")
    )
    even = F.struct(F.lit(-1).alias("level"), F.array(*[F.lit(1.0 / n_classes)] * n_classes).alias("probs"))

    def step(state, at):
        total = F.aggregate(at["counts"], F.lit(0).cast("bigint"), lambda a, n: a + n)
        probs = F.zip_with(at["counts"], state["probs"], lambda n, p: (n + F.lit(pull) * p) / (total + F.lit(pull)))
        deeper = F.struct(at["level"].alias("level"), probs.alias("probs"))
        return F.when(total > 0, deeper).otherwise(state)

    return by_id.withColumn("_end", F.aggregate("levels", even, step)).select(
        "id", "y", "fold", F.col("_end.level").alias("level"), F.col("_end.probs").alias("probs")
    )

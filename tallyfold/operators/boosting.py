"""Boosted trees on histograms, for any number of classes.

Features are cut at quantiles into bins. A round grows one tree for each class on the softmax
loss, all of them level by level in one pass: tasks add up gradients and hessians by (class,
node, feature, bin), Spark sums what they found, and the best split of every node is taken from
running sums over the bins. Only one child of each split is counted; its sibling is the parent
less the child. Gradients and hessians are whole steps of 1 / STEPS, so sums don't depend on
the order of the rows.

A task holds nodes x features x bins numbers and the driver the splits, whatever the rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyfold.sources.shared import settle, small_table

STEPS = 1 << 20
#: Bin of a missing value; values have bins from 1 on.
MISSING = 0


@dataclass
class Boosted:
    """Trees by (round, class). Nodes are numbered as in a heap: 1, then 2n and 2n + 1.

    ``edges[f]`` are the upper ends of the bins of feature f, but for the last bin. Of a tree,
    ``splits[node]`` is (feature, last bin that goes left), ``leaves[node]`` what it adds.
    """

    edges: list[np.ndarray]
    n_classes: int
    depth: int
    trees: list[list[tuple[dict, dict]]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        """Bins of a matrix of values; NaN is missing."""
        out = np.empty(x.shape, "uint8")
        for f, edges in enumerate(self.edges):
            out[:, f] = np.searchsorted(edges, x[:, f]) + 1
        out[np.isnan(x)] = MISSING
        return out

    def margins(self, bins: np.ndarray, first: int = 0) -> np.ndarray:
        """What the trees from round ``first`` on add for each row and class."""
        out = np.zeros((len(bins), self.n_classes))
        for trees in self.trees[first:]:
            for c, (splits, leaves) in enumerate(trees):
                value = np.zeros(2 << self.depth)
                value[list(leaves)] = list(leaves.values())
                out[:, c] += value[walk(bins, splits, self.depth)]
        return out


def walk(bins: np.ndarray, splits: dict[int, tuple[int, int]], depth: int) -> np.ndarray:
    """The node in which each row ends after ``depth`` levels."""
    feature, last = np.zeros(2 << depth, "int64"), np.full(2 << depth, -1, "int64")
    for node, (f, b) in splits.items():
        feature[node], last[node] = f, b
    node = np.ones(len(bins), "int64")
    rows = np.arange(len(bins))
    for _ in range(depth):
        split = last[node] >= 0
        right = bins[rows, feature[node]] > last[node]
        node = np.where(split, 2 * node + right, node)
    return node


def softmax_rows(margins: np.ndarray) -> np.ndarray:
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def steps_of(x: np.ndarray) -> np.ndarray:
    return np.floor(x * STEPS + 0.5).astype("int64")


def quantile_edges(
    df: DataFrame, x: str, n_features: int, n_bins: int, accuracy: int = 10_000
) -> list[np.ndarray]:
    """Ascending edges of each feature: the values at ranks i / n_bins, equal ones once.

    Ranks are within 1 / accuracy of all rows, exact up to that many rows. One digest a
    feature is merged, not the values.
    """
    shares = [i / n_bins for i in range(1, n_bins)]
    values = df.select(F.posexplode(x).alias("f", "v")).filter(
        F.col("v").isNotNull() & ~F.isnan("v") & (F.col("f") < n_features)
    )
    found = values.groupBy("f").agg(
        F.percentile_approx(F.col("v").cast("double"), shares, accuracy).alias("edges")
    )
    edges = [np.zeros(0)] * n_features
    for row in found.collect():
        edges[row["f"]] = np.unique(np.array(row["edges"], "float64"))
    return edges


def _matrix(column: pa.Array, n_features: int) -> np.ndarray:
    """Rows of ``n_features`` values; what a shorter or missing vector lacks is missing."""
    if not column.null_count and not column.flatten().null_count:
        sizes = np.diff(column.offsets.to_numpy())
        if (sizes == n_features).all():
            flat = column.flatten().to_numpy(zero_copy_only=False)
            return flat.astype("float64").reshape(len(column), n_features)
    out = np.full((len(column), n_features), np.nan)
    for i, values in enumerate(column.to_pylist()):
        if values is not None:
            known = [np.nan if v is None else v for v in values[:n_features]]
            out[i, : len(known)] = known
    return out


def _binned(df: DataFrame, model: Boosted, x: str, y: str, n_classes: int) -> DataFrame:
    """(y, bins, margins): labelled rows, with the margins at the start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = model.bins(_matrix(batch.column(1), len(model.edges)))
            yield pa.RecordBatch.from_pydict(
                {
                    "y": batch.column(0),
                    "bins": pa.array([b.tobytes() for b in bins], pa.binary()),
                    "margins": pa.array([b"\0" * (8 * n_classes)] * len(bins), pa.binary()),
                }
            )

    labelled = df.filter(F.col(y).between(0, n_classes - 1))
    return labelled.select(F.col(y).cast("int").alias("y"), F.col(x).alias("x")).mapInArrow(
        run, "y int, bins binary, margins binary"
    )


def _unpacked(batch: pa.RecordBatch, model: Boosted, since: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(y, bins, margins) of a batch, with the trees from round ``since`` on added."""
    y = batch.column(0).to_numpy(zero_copy_only=False)
    raw = [np.frombuffer(b"".join(batch.column(i).to_pylist()), t) for i, t in ((1, "uint8"), (2, "float64"))]
    bins = raw[0].reshape(len(y), len(model.edges))
    return y, bins, raw[1].reshape(len(y), model.n_classes) + model.margins(bins, since)


def _histogram(
    rows: DataFrame, model: Boosted, since: int, growing: list[dict], counted: list[set], n_bins: int
) -> DataFrame:
    """(class, node, feature, bin, n, g, h) of the counted nodes, where there are rows.

    A task adds up its batches in arrays and hands on the cells that aren't empty.
    """
    n_features, n_classes = len(model.edges), model.n_classes
    levels = max((node.bit_length() for nodes in counted for node in nodes), default=1)
    slots = [{node: i for i, node in enumerate(sorted(nodes))} for nodes in counted]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = [(len(s), n_features, n_bins + 1) for s in slots]
        sums = [[np.zeros(s, "int64") for _ in range(3)] for s in shape]
        for batch in batches:
            y, bins, margins = _unpacked(batch, model, since)
            probs = softmax_rows(margins)
            for c in range(n_classes):
                place = np.full(2 << levels, -1, "int64")
                for node, i in slots[c].items():
                    place[node] = i
                at = place[walk(bins, growing[c], levels - 1)]
                inside = np.flatnonzero(at >= 0)
                if not len(inside):
                    continue
                p = probs[inside, c]
                told = (np.ones(len(p), "int64"), steps_of(p - (y[inside] == c)), steps_of(p * (1 - p)))
                cell = (at[inside, None] * n_features + np.arange(n_features)) * (n_bins + 1) + bins[inside]
                for total, value in zip(sums[c], told):
                    # whole numbers far below 2 ** 53 in a batch, so the sums are exact
                    weight = np.repeat(value.astype("float64"), n_features)
                    added = np.bincount(cell.ravel(), weight, total.size)
                    total += added.astype("int64").reshape(total.shape)
        for c in range(n_classes):
            slot, f, b = np.nonzero(sums[c][0])
            named = np.array(sorted(slots[c]), "int64")
            columns = [np.full(len(slot), c), named[slot], f, b, *[s[slot, f, b] for s in sums[c]]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(columns, types)], list(names)
            )

    names = ("class", "node", "feature", "bin", "n", "g", "h")
    types = (pa.int32(),) * 4 + (pa.int64(),) * 3
    found = rows.mapInArrow(count, "class int, node int, feature int, bin int, n bigint, g bigint, h bigint")
    return found.groupBy("class", "node", "feature", "bin").agg(*[F.sum(c).alias(c) for c in "ngh"])


def _with_siblings(counted: DataFrame, parents: DataFrame, splits: Sequence) -> DataFrame:
    """The counted children, and their siblings: the parent's cells less the child's."""
    chosen = [(s["class"], s["node"], 2 * s["node"] + s["other"]) for s in splits]
    others = small_table(
        counted.sparkSession, chosen, {"class": pa.int32(), "node": pa.int32(), "sibling": pa.int32()}
    )
    # one row a split
    kept = parents.join(F.broadcast(others), ["class", "node"]).select(
        "class", F.col("sibling").alias("node"), "feature", "bin", "n", "g", "h"
    )
    less = counted.select(
        "class", F.col("node").bitwiseXOR(F.lit(1)).alias("node"), "feature", "bin", *[(-F.col(c)).alias(c) for c in "ngh"]
    )
    siblings = kept.unionByName(less).groupBy("class", "node", "feature", "bin")
    return counted.unionByName(siblings.agg(*[F.sum(c).alias(c) for c in "ngh"]).filter("n > 0"))


def best_splits(cells: DataFrame, penalty: float, min_rows: int) -> DataFrame:
    """(class, node, feature, bin, gain, n, g, h, n_left, g_left, h_left): the best split of
    every node that has one with a gain. Ties go to the first feature, then the first bin."""
    keys = ["class", "node", "feature"]
    upto = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    summed = cells.select(
        *keys,
        "bin",
        *[F.sum(c).over(upto).alias(f"{c}_left") for c in "ngh"],
        *[F.sum(c).over(whole).alias(c) for c in "ngh"],
    )

    def gain(g, h):
        return g.cast("double") * g / (h + F.lit(penalty * STEPS))

    left = gain(F.col("g_left"), F.col("h_left"))
    right = gain(F.col("g") - F.col("g_left"), F.col("h") - F.col("h_left"))
    scored = summed.withColumn("gain", (left + right - gain(F.col("g"), F.col("h"))) / STEPS)
    fit = (F.col("n_left") >= min_rows) & (F.col("n") - F.col("n_left") >= min_rows) & (F.col("gain") > 1e-9)
    order = F.struct("gain", (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"))
    names = ["feature", "bin", "gain", "n", "g", "h", "n_left", "g_left", "h_left"]
    best = scored.filter(fit).groupBy("class", "node").agg(F.max_by(F.struct(*names), order).alias("s"))
    return best.select("class", "node", *[f"s.{c}" for c in names])


def _totals(cells: DataFrame) -> DataFrame:
    """(class, node, g, h) of each node; every feature counts all of its rows."""
    return cells.filter("feature = 0").groupBy("class", "node").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))


def grow_round(
    rows: DataFrame, model: Boosted, since: int, n_bins: int, penalty: float, min_rows: int
) -> tuple[list[list], list[dict[int, tuple[int, int]]], list[dict[int, tuple[int, int]]]]:
    """One tree a class: (the splits found on each level, split of each node, sums of each
    node). One pass over the rows a level."""
    growing = [{} for _ in range(model.n_classes)]
    sums = [{} for _ in range(model.n_classes)]
    counted = [{1} for _ in range(model.n_classes)]
    parents, before, levels = None, [], []
    for level in range(model.depth):
        if not any(counted):
            break
        cells = _histogram(rows, model, since, growing, counted, n_bins)
        if parents is not None:
            cells = _with_siblings(settle(cells), parents, before)
        cells = settle(cells)
        if level == 0:
            for t in _totals(cells).collect():
                sums[t["class"]][1] = (t["g"], t["h"])
        found = best_splits(cells, penalty, min_rows).orderBy("class", "node").collect()
        levels.append(found)
        counted = [set() for _ in range(model.n_classes)]
        before = []
        for s in found:
            c, node = s["class"], s["node"]
            growing[c][node] = (s["feature"], s["bin"])
            sums[c][2 * node] = (s["g_left"], s["h_left"])
            sums[c][2 * node + 1] = (s["g"] - s["g_left"], s["h"] - s["h_left"])
            # the smaller child is counted, the other one is what is left
            right = int(2 * s["n_left"] > s["n"])
            counted[c].add(2 * node + right)
            before.append({"class": c, "node": node, "other": 1 - right})
        parents = cells
    return levels, growing, sums


def fit_boosted(
    df: DataFrame,
    n_classes: int,
    n_features: int,
    x: str = "x",
    y: str = "y",
    rounds: int = 20,
    depth: int = 4,
    n_bins: int = 64,
    rate: float = 0.3,
    penalty: float = 1.0,
    min_rows: int = 5,
    write_every: int = 8,
) -> Boosted:
    """Fit on the rows whose class is in 0 .. n_classes-1.

    Missing values (null, NaN, a short vector) go to the left of every split. No labelled
    row: all classes stay alike. Margins are written anew every ``write_every`` rounds; the
    trees since then are walked again in each pass.
    """
    if not 2 <= n_bins <= 254:
        raise ValueError("bins must be between 2 and 254")
    labelled = df.filter(F.col(y).between(0, n_classes - 1))
    model = Boosted(quantile_edges(labelled, x, n_features, n_bins), n_classes, depth)
    rows, since = settle(_binned(labelled, model, x, y, n_classes)), 0
    for r in range(rounds):
        _, growing, sums = grow_round(rows, model, since, n_bins, penalty, min_rows)
        trees = []
        for splits, total in zip(growing, sums):
            ends = [node for node in total if node not in splits]
            trees.append(
                (splits, {n: -rate * total[n][0] / (total[n][1] + penalty * STEPS) for n in ends})
            )
        model.trees.append(trees)
        if not any(splits for splits, _ in trees):
            break
        if (r + 1) % write_every == 0 and r + 1 < rounds:
            rows, since = settle(_moved(rows, model, since)), r + 1
    return model


def _moved(rows: DataFrame, model: Boosted, since: int) -> DataFrame:
    """The rows with the newest trees in their margins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, _, margins = _unpacked(batch, model, since)
            packed = pa.array([m.tobytes() for m in margins], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed], ["y", "bins", "margins"])

    return rows.mapInArrow(run, "y int, bins binary, margins binary")


def first_splits(
    df: DataFrame, n_classes: int, n_features: int, x: str = "x", y: str = "y", depth: int = 3,
    n_bins: int = 16, penalty: float = 1.0, min_rows: int = 5,
) -> DataFrame:
    """The splits of the first round's trees: what each class looks at first.

    (class, node, feature, bin, threshold, gain, n, g, h, n_left, g_left, h_left); values up
    to the threshold go left. At most classes x 2 ** depth rows.
    """
    labelled = df.filter(F.col(y).between(0, n_classes - 1))
    model = Boosted(quantile_edges(labelled, x, n_features, n_bins), n_classes, depth)
    rows = settle(_binned(labelled, model, x, y, n_classes))
    levels, _, _ = grow_round(rows, model, 0, n_bins, penalty, min_rows)
    found = [
        (s["class"], s["node"], s["feature"], s["bin"], _threshold(model, s), *[s[c] for c in ("gain", "n", "g", "h", "n_left", "g_left", "h_left")])
        for splits in levels
        for s in splits
    ]
    ints = {c: pa.int32() for c in ("class", "node", "feature", "bin")}
    longs = {c: pa.int64() for c in ("n", "g", "h", "n_left", "g_left", "h_left")}
    return small_table(df.sparkSession, found, {**ints, "threshold": pa.float64(), "gain": pa.float64(), **longs})


def _threshold(model: Boosted, split) -> float | None:
    """The greatest value that goes left; none if only missing ones do."""
    edges = model.edges[split["feature"]]
    return float(edges[split["bin"] - 1]) if split["bin"] > MISSING and len(edges) else None


def boosted_scores(
    df: DataFrame, model: Boosted, x: str = "x", keep: Sequence[str] = ("id", "y"), candidate: str = "boosting"
) -> DataFrame:
    """(keep.., candidate, probs): softmax of the summed trees, so probabilities add up to 1."""
    kept = list(keep)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*kept).schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = model.bins(_matrix(batch.column(len(kept)), len(model.edges)))
            probs = softmax_rows(model.margins(bins)) if len(bins) else np.zeros((0, model.n_classes))
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(i) for i in range(len(kept))],
                    pa.array([candidate] * len(bins), pa.string()),
                    pa.array(list(probs), pa.list_(pa.float64())),
                ],
                [*kept, "candidate", "probs"],
            )

    return df.select(*kept, F.col(x).alias("_x")).mapInArrow(run, f"{fields}, candidate string, probs array<double>")


def save_boosted(model: Boosted, spark: SparkSession, path: str) -> None:
    """Write the model as one row a node and one a feature, below ``path``."""
    nodes = [
        (r, c, n, *(splits.get(n) or (None, None)), leaves.get(n))
        for r, trees in enumerate(model.trees)
        for c, (splits, leaves) in enumerate(trees)
        for n in {**splits, **leaves}
    ]
    ints = {c: pa.int32() for c in ("round", "class", "node", "feature", "bin")}
    small_table(spark, nodes, {**ints, "leaf": pa.float64()}).write.parquet(f"{path}/nodes")
    edges = [(f, model.n_classes, model.depth, list(map(float, e))) for f, e in enumerate(model.edges)]
    ints = {c: pa.int32() for c in ("feature", "n_classes", "depth")}
    small_table(spark, edges, {**ints, "edges": pa.list_(pa.float64())}).write.parquet(f"{path}/features")


def load_boosted(spark: SparkSession, path: str) -> Boosted:
    features = sorted(spark.read.parquet(f"{path}/features").collect(), key=lambda r: r["feature"])
    model = Boosted(
        [np.array(r["edges"], "float64") for r in features], features[0]["n_classes"], features[0]["depth"]
    )
    for row in spark.read.parquet(f"{path}/nodes").orderBy("round", "class", "node").collect():
        while len(model.trees) <= row["round"]:
            model.trees.append([({}, {}) for _ in range(model.n_classes)])
        splits, leaves = model.trees[row["round"]][row["class"]]
        if row["feature"] is not None:
            splits[row["node"]] = (row["feature"], row["bin"])
        else:
            leaves[row["node"]] = row["leaf"]
    return model

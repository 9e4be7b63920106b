"""Hard negatives by secondary sort.

Anchors meet all rows in cells, a block of anchors with a block of rows. A cell hands on, for
each anchor, only what can be among the first of all cells, so no pair is shuffled that its
own block beats. What is left is packed into keys (anchor, descending score, kind, id), which
Spark partitions by anchor and sorts; an iterator reads each anchor's rows once, opens a
window at each positive and emits the negatives that fall into it.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.sources.shared import settle

EVERY = 50
SCALE = 256
POSITIVES = 5
NEGATIVES = 3
#: A negative's score lies between these hundredths of its positive's.
LOW, HIGH = 50, 95
ROWS_AT_ONCE = 8_192
ANCHORS_AT_ONCE = 16_384
#: Rows of the score matrix that a task holds at a time.
SCORED_AT_ONCE = 256

POSITIVE, NEGATIVE = 0, 1
KEY = np.dtype([("anchor", ">u8"), ("score", ">u8"), ("kind", "u1"), ("id", ">u8"), ("row", ">u8")])
PACKED = ">QQBQQ"
SIGN = 1 << 63
RESULT = (
    "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, "
    "positive_score bigint, negative_score bigint"
)


def _matrix(column: pa.ChunkedArray, width: int, scale: int) -> np.ndarray:
    """floor(scale * x) of each vector, filled up with zeros to ``width``."""
    lists = column.combine_chunks()
    values = np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False).astype("float64"))
    sizes = np.diff(lists.offsets.to_numpy()).astype("int64")
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row, place] = values
    return out


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers, as 64-bit integers, exact or an error."""
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1]
    if most < 2**53:
        return (a @ b.T).astype("int64")
    whole = np.vectorize(int, otypes=[object])
    found = whole(a).dot(whole(b).T) if a.size and b.size else np.zeros((len(a), len(b)), object)
    if found.size and max(abs(found.max()), abs(found.min())) >= SIGN:
        raise OverflowError("a score does not fit into 64 bits")
    return found.astype("int64")


def window(score: int) -> tuple[int, int]:
    """The least and the greatest score of a hard negative of this positive."""
    return -((-LOW * score) // 100), (HIGH * score) // 100


def _first(scores: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Of the places ``at``, ascending, the n with the highest scores, earlier ones on ties."""
    if len(at) > n:
        least = np.partition(scores[at], len(at) - n)[len(at) - n]
        at = at[scores[at] >= least]
    return at[np.argsort(-scores[at], kind="stable")[:n]]


class Cell:
    """A block of anchors and a block of rows, the latter by (id, row)."""

    def __init__(self, anchors: pa.Table, rows: pa.Table, scale: int):
        rows = rows.sort_by([("id", "ascending"), ("row", "ascending")])
        self.anchors, self.scale = anchors, scale
        widths = [np.diff(t["x"].combine_chunks().offsets.to_numpy()).max(initial=0) for t in (anchors, rows)]
        self.width = int(max(widths))
        self.id, self.row, self.label = (rows[c].to_numpy() for c in ("id", "row", "label"))
        self.x = _matrix(rows["x"], self.width, scale)
        self.alike: dict = {}

    def same_label(self, label) -> np.ndarray:
        if label not in self.alike:
            self.alike[label] = self.label == label
        return self.alike[label]

    def scored(self) -> Iterator[tuple[int, np.ndarray]]:
        """(place of the anchor, its scores)."""
        for lo in range(0, self.anchors.num_rows, SCORED_AT_ONCE):
            part = self.anchors.slice(lo, SCORED_AT_ONCE)
            found = exact_products(_matrix(part["x"], self.width, self.scale), self.x)
            yield from ((lo + i, line) for i, line in enumerate(found))

    def keys(self, kind: int, found: list[tuple[int, int, np.ndarray, np.ndarray]]) -> pa.Table:
        """Packed keys of (row and id of the anchor, places, scores)."""
        sizes = [len(at) for _, _, at, _ in found]
        packed = np.zeros(sum(sizes), KEY)
        at = np.concatenate([f[2] for f in found]) if found else np.zeros(0, "int64")
        scores = np.concatenate([f[3] for f in found]) if found else np.zeros(0, "int64")
        packed["anchor"] = np.repeat(np.array([f[0] for f in found], "uint64"), sizes)
        packed["score"] = (SIGN - 1) - scores.astype("object") if len(scores) else 0
        packed["kind"] = kind
        packed["id"] = self.id[at].astype("int64").view("uint64") ^ np.uint64(SIGN)
        packed["row"] = self.row[at]
        raw = pa.Array.from_buffers(pa.binary(KEY.itemsize), len(packed), [None, pa.py_buffer(packed.tobytes())])
        named = np.repeat(np.array([f[1] for f in found], "int64"), sizes)
        return pa.table({"key": raw.cast(pa.binary()), "anchor_id": pa.array(named)})


def _sorted_by_anchor(packed: DataFrame, parts: int):
    """RDD of (key, anchor's id): an anchor's keys in one partition, in order."""
    pairs = packed.rdd.map(lambda r: (bytes(r[0]), r[1]))
    return pairs.repartitionAndSortWithinPartitions(parts, lambda key: zlib.crc32(key[:8]))


def _anchors(rows: Iterator) -> Iterator[tuple[int, int, Iterator[tuple[int, int, int]]]]:
    """(row of the anchor, its id, iterator of (score, kind, id)) of sorted keys."""
    for (anchor, name), keys in groupby(rows, lambda r: (r[0][:8], r[1])):
        unpacked = (struct.unpack(PACKED, key) for key, _ in keys)
        yield (
            int.from_bytes(anchor, "big"),
            name,
            ((SIGN - 1 - score, kind, i - SIGN) for _, score, kind, i, _ in unpacked),
        )


def _first_positives(rows: Iterator, n: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    for anchor, _, found in _anchors(rows):
        kept = []
        for score, _, i in found:
            if len(kept) < n:
                kept.append((i, score))
        yield anchor, kept


def emit(rows: Iterator, n: int) -> Iterator[tuple[int, int, int, int, int, int]]:
    """Read each anchor's keys once: a positive opens its window, a negative is emitted for
    every window that it falls into and that isn't full. Holds the open windows only."""
    for _, name, found in _anchors(rows):
        opened = []
        for score, kind, i in found:
            if kind == POSITIVE:
                opened.append([i, score, *window(score), 0])
                continue
            for seen in opened:
                if seen[2] <= score <= seen[3] and seen[4] < n:
                    seen[4] += 1
                    yield name, seen[0], seen[4], i, seen[1], score


def mine(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    every: int = EVERY,
    scale: int = SCALE,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    rows_at_once: int = ROWS_AT_ONCE,
    anchors_at_once: int = ANCHORS_AT_ONCE,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id is divisible by ``every``. A score is the inner product of
    floor(scale * x); higher ones come first, then smaller ids. Every anchor's first
    ``positives`` other rows of its label get the first ``negatives`` rows of other labels
    whose score lies between LOW and HIGH hundredths of theirs.

    Rows without id or label, without a vector or with a null or non-finite component take no
    part. A repeated id stands for as many rows: each is an anchor, a positive, a negative of
    its own. Vectors of unequal length are compared over the components that both have; an
    empty one scores 0. Scores are exact; one beyond 64 bits is an error. Anchors without
    positives, windows without negatives and empty tables give no rows; other columns are
    left out.

    A cell is at most about ``anchors_at_once`` x ``rows_at_once`` rows, whatever the input.
    A row is sent once for each block of anchors, an anchor once for each block of rows; of
    the scores, a cell hands on ``positives`` and then ``positives`` x ``negatives`` an anchor.
    """
    spark = vectors.sparkSession
    finite = F.forall(
        F.col("x"), lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False))
    )
    rows = vectors.select(
        F.col(id_col).cast("bigint").alias("id"), F.col(label).alias("label"), F.col(vector).alias("x")
    ).filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & finite)
    rows = settle(rows.withColumn("row", F.monotonically_increasing_id()))
    asks = F.col("id") % every == 0
    seen = rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if(asks).alias("anchors")).first()
    if not seen["anchors"]:
        return spark.createDataFrame([], RESULT)
    row_blocks = -(-seen["rows"] // rows_at_once)
    anchor_blocks = -(-seen["anchors"] // anchors_at_once)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def block(n: int):
        return F.pmod(F.xxhash64("row"), F.lit(n))

    def every_block(n: int):
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))

    def cells(anchors: DataFrame, pick) -> DataFrame:
        left = anchors.withColumn("ab", block(anchor_blocks)).withColumn("rb", every_block(row_blocks))
        right = rows.withColumn("rb", block(row_blocks)).withColumn("ab", every_block(anchor_blocks))
        grouped = left.groupBy("ab", "rb").cogroup(right.groupBy("ab", "rb"))
        return grouped.applyInArrow(pick, "key binary, anchor_id bigint")

    def best_positives(anchors: pa.Table, block_rows: pa.Table) -> pa.Table:
        cell = Cell(anchors, block_rows, scale)
        row, name, own = (anchors[c].to_pylist() for c in ("row", "id", "label"))
        found = []
        for i, scores in cell.scored():
            at = np.flatnonzero(cell.same_label(own[i]) & (cell.row != row[i]))
            at = _first(scores, at, positives)
            found.append((row[i], name[i], at, scores[at]))
        return cell.keys(POSITIVE, found)

    def hard_ones(anchors: pa.Table, block_rows: pa.Table) -> pa.Table:
        cell = Cell(anchors, block_rows, scale)
        row, name, own, wins = (anchors[c].to_pylist() for c in ("row", "id", "label", "wins"))
        found = []
        for i, scores in cell.scored():
            unlike = ~cell.same_label(own[i])
            picked = [np.zeros(0, "int64")]
            for low, high in {window(w["score"]) for w in wins[i]}:
                at = np.flatnonzero(unlike & (scores >= low) & (scores <= high))
                picked.append(_first(scores, at, negatives))
            at = np.unique(np.concatenate(picked))
            found.append((row[i], name[i], at, scores[at]))
        return cell.keys(NEGATIVE, found)

    anchors = rows.filter(asks)
    first = _sorted_by_anchor(cells(anchors, best_positives), parts)
    wins = spark.createDataFrame(
        first.mapPartitions(lambda keys: _first_positives(keys, positives)),
        "row bigint, wins array<struct<id: bigint, score: bigint>>",
    )
    asked = settle(anchors.join(wins, "row"))

    def opening(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The positives as keys."""
        for batch in batches:
            told = [
                (struct.pack(PACKED, r["row"], SIGN - 1 - w["score"], POSITIVE, w["id"] + SIGN, n), r["id"])
                for r in batch.to_pylist()
                for n, w in enumerate(r["wins"])
            ]
            yield pa.RecordBatch.from_pydict(
                {
                    "key": pa.array([k for k, _ in told], pa.binary()),
                    "anchor_id": pa.array([i for _, i in told], pa.int64()),
                }
            )

    opened = asked.select("row", "id", "wins").mapInArrow(opening, "key binary, anchor_id bigint")
    stream = _sorted_by_anchor(opened.unionByName(cells(asked, hard_ones)), parts)
    return spark.createDataFrame(stream.mapPartitions(lambda keys: emit(keys, negatives)), RESULT)

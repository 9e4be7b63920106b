"""Document fingerprints from improbable features.

A feature is a window of WINDOW bytes. Its entropy, in steps of 1/64 bit, is its level, and a
level's rarity is its rank by how few windows of the corpus are on it. Among every NEIGHBOURS
consecutive windows of a text the rarest one, the first on ties, scores a point; windows with
POPULAR points, and the rarest of the text, are selected. Their hashes go, in order, into a
chain of Bloom filters. Two fingerprints are alike as far as their filters' common bits exceed
what chance gives.

A fingerprint is text: number of features, ``:``, base64 of the filters.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.sources.shared import settle

WINDOW = 32
LEVEL_SHIFT = 19
LEVELS = 321
#: Windows below this level (a quarter of the greatest entropy) say little and are taken last.
WEAK = LEVELS // 4
NEIGHBOURS = 32
POPULAR = 8
FILTER_BITS = 2048
FILTER_FEATURES = 160
HASHES = 5
HASH_BITS = 11

CHUNK = 1 << 16
PIECE_BYTES = 2 << 20
PLACE_BITS = 40
LOCAL_BITS = 20
NOWHERE = np.iinfo("int64").max
BARRED = np.iinfo("int32").max
LOCAL = (1 << LOCAL_BITS) - 1

_counts = np.arange(WINDOW + 1, dtype="float64")
_mass = np.rint(_counts * np.log2(np.maximum(_counts, 1)) * (1 << 20)).astype("int64")
#: What one more occurrence adds to the sum of c log2 c (in 1 / 2**20), from c to c + 1.
GAIN = np.diff(_mass)
WHOLE = int(_mass[WINDOW])


def window_levels(data: np.ndarray) -> np.ndarray:
    """Entropy level of each window of the bytes: 0 if all are equal, the last if none are.

    The sum of c log c over a window's byte counts c is carried from window to window: it
    loses what the leaving byte had added and gains what the entering one adds. Both depend
    on how often that byte occurs among its next or last WINDOW - 1 neighbours.
    """
    if len(data) < WINDOW:
        return np.zeros(0, "int64")
    before = np.zeros(len(data), "uint8")
    after = np.zeros(len(data), "uint8")
    for d in range(1, WINDOW):
        same = (data[d:] == data[:-d]).view("uint8")
        before[d:] += same
        after[:-d] += same
    mass = np.empty(len(data) - WINDOW + 1, "int64")
    mass[0] = GAIN[before[:WINDOW]].sum()
    mass[1:] = GAIN[before[WINDOW:]] - GAIN[after[: len(mass) - 1]]
    return (WHOLE - np.cumsum(mass)) >> LEVEL_SHIFT


def _inside(n: int, ends: np.ndarray, reach: int) -> np.ndarray:
    """True where ``reach`` bytes from there on end no later than their text."""
    ok = np.ones(n, bool)
    bad = (ends[:, None] - np.arange(1, reach)[None, :]).ravel()
    ok[bad[(bad >= 0) & (bad < n)]] = False
    return ok


def _chunks(data: np.ndarray, ends: np.ndarray, extra: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(start, own length, levels of the windows, ends of texts from the start on)."""
    for lo in range(0, len(data), CHUNK):
        part = data[lo : lo + CHUNK + extra]
        near = ends[np.searchsorted(ends, lo, "right") : np.searchsorted(ends, lo + len(part) + extra, "right") + 1]
        yield lo, min(CHUNK, len(data) - lo), window_levels(part), near - lo


def level_counts(texts: list[bytes]) -> np.ndarray:
    """How many windows of the texts are on each level."""
    data = np.frombuffer(b"".join(texts), "uint8")
    ends = np.cumsum([len(t) for t in texts if t], dtype="int64")
    total = np.zeros(LEVELS, "int64")
    for _, own, levels, near in _chunks(data, ends, WINDOW - 1):
        levels = levels[:own]
        total += np.bincount(levels[_inside(len(levels), near, WINDOW)], minlength=LEVELS)
    return total


def rarity(counts: np.ndarray) -> np.ndarray:
    """Rank of each level: few windows first, the higher level on ties; weak levels last."""
    level = np.arange(LEVELS)
    order = np.lexsort((-level, counts, level < WEAK))
    rank = np.empty(LEVELS, "int32")
    rank[order] = level
    return rank


def select_features(data: np.ndarray, ends: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Places of the selected windows in texts that lie one after the other, none empty.

    Works through the bytes in chunks, so that memory beyond the bytes is bounded however
    long a text is; points that a window gets in two chunks are added.
    """
    least = np.full(len(ends), NOWHERE)
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    places, points = [], []
    for lo, own, levels, near in _chunks(data, ends, NEIGHBOURS + WINDOW - 2):
        if not len(levels):
            continue
        keys = (rank[levels] << LOCAL_BITS) + np.arange(len(levels), dtype="int32")
        keys[~_inside(len(keys), near, WINDOW)] = BARRED
        first, last = np.searchsorted(ends, lo, "right"), np.searchsorted(starts, lo + min(own, len(keys)))
        cuts = np.maximum(starts[first:last] - lo, 0)
        lowest = np.minimum.reduceat(keys[:own], cuts).astype("int64")
        there = ((lowest >> LOCAL_BITS) << PLACE_BITS) + (lowest & LOCAL) + lo
        there[lowest == BARRED] = NOWHERE
        least[first:last] = np.minimum(least[first:last], there)
        best, width = keys, 1
        while width < NEIGHBOURS:
            if len(best) <= width:
                best = best[:0]
                break
            best, width = np.minimum(best[:-width], best[width:]), 2 * width
        best = best[:own]
        # the place of the rarest never goes back: equal ones lie together
        best = best[_inside(len(best), near, NEIGHBOURS + WINDOW - 1)] & LOCAL
        runs = np.flatnonzero(np.diff(best, prepend=-1))
        places.append(best[runs].astype("int64") + lo)
        points.append(np.diff(runs, append=len(best)))
    least = least[least < NOWHERE] & ((1 << PLACE_BITS) - 1)
    found = np.concatenate([*places, least])
    n = np.concatenate([*points, np.full(len(least), POPULAR)])
    if not len(found):
        return np.zeros(0, "int64")
    found, back = np.unique(found, return_inverse=True)
    return found[np.bincount(back, weights=n) >= POPULAR]


def mixed(words: np.ndarray) -> np.ndarray:
    """64-bit hash of each row of 64-bit words, folded one after the other."""
    h = np.full(len(words), 0x9E3779B97F4A7C15, "uint64")
    for column in words.T:
        h = h ^ column
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h = h ^ (h >> np.uint64(31))
    return h


def _distinct(text: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Places of the first of equal (text, hash), in order."""
    order = np.lexsort((np.arange(len(hashes)), hashes, text))
    t, h = text[order], hashes[order]
    new = np.ones(len(order), bool)
    new[1:] = (t[1:] != t[:-1]) | (h[1:] != h[:-1])
    return np.sort(order[new])


def make_filters(texts: list[bytes], rank: np.ndarray) -> list[tuple[int, bytes]]:
    """(number of features, filters) of each text. One shorter than a window is a single
    feature, an empty one has none."""
    filled = [i for i, t in enumerate(texts) if t]
    data = np.frombuffer(b"".join(texts), "uint8")
    ends = np.cumsum([len(texts[i]) for i in filled], dtype="int64")
    at = select_features(data, ends, rank)
    words = data[at[:, None] + np.arange(WINDOW)].reshape(len(at), WINDOW).view("<u8")
    owner = np.array(filled, "int64")[np.searchsorted(ends, at, "right")] if len(at) else at
    short = [i for i in filled if len(texts[i]) < WINDOW]
    padded = b"".join(texts[i].ljust(WINDOW - 1, b"\0") + bytes([len(texts[i])]) for i in short)
    words = np.concatenate([words, np.frombuffer(padded, "<u8").reshape(-1, WINDOW // 8)])
    owner = np.concatenate([owner, np.array(short, "int64")])
    order = np.argsort(owner, kind="stable")
    owner, hashes = owner[order], mixed(words[order])
    kept = _distinct(owner, hashes)
    owner, hashes = owner[kept], hashes[kept]

    n = np.bincount(owner, minlength=len(texts))
    first = np.cumsum(n) - n
    filters = -(-n // FILTER_FEATURES)
    base = np.cumsum(filters) - filters
    chain = base[owner] + (np.arange(len(owner)) - first[owner]) // FILTER_FEATURES
    bits = np.zeros((int(filters.sum()), FILTER_BITS), bool)
    for j in range(HASHES):
        bits[chain, (hashes >> np.uint64(HASH_BITS * j)) & np.uint64(FILTER_BITS - 1)] = True
    packed = np.packbits(bits, axis=1)
    return [
        (int(n[i]), packed[base[i] : base[i] + filters[i]].tobytes()) for i in range(len(texts))
    ]


def make_fingerprints(texts: list[bytes], rank: np.ndarray) -> list[str]:
    """Fingerprint of each text."""
    return [f"{n}:{base64.b64encode(bits).decode()}" for n, bits in make_filters(texts, rank)]


def unpacked(n: int, filters: bytes) -> tuple[int, np.ndarray]:
    """Number of features, and the bits of each filter as 0 or 1."""
    raw = np.frombuffer(filters, "uint8").reshape(-1, FILTER_BITS // 8)
    return n, np.unpackbits(raw, axis=1).astype("float32")


def overlap(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> float:
    """How alike two fingerprints are, 0 to 1: 1 for equal ones, 0 if only one is empty.

    Each filter of the one with fewer features is held against its best match in the other:
    common bits beyond those expected by chance, as a share of the most there can be; the
    mean weighs filters by their bits. With equally many features, the mean of both ways.
    """
    (n_a, x), (n_b, y) = a, b
    if n_a == n_b and np.array_equal(x, y):
        return 1.0
    if not n_a or not n_b:
        return 0.0
    size_x, size_y = x.sum(axis=1)[:, None], y.sum(axis=1)[None, :]
    chance = size_x * size_y / FILTER_BITS
    most = np.minimum(size_x, size_y) - chance
    score = np.clip((x @ y.T - chance) / np.where(most > 0, most, 1), 0, 1) * (most > 0)
    mean_x = float((score.max(axis=1) * size_x[:, 0]).sum() / size_x.sum())
    mean_y = float((score.max(axis=0) * size_y[0]).sum() / size_y.sum())
    return mean_x if n_a < n_b else mean_y if n_b < n_a else (mean_x + mean_y) / 2


def likeness(a: str, b: str) -> float:
    """``overlap`` of two fingerprints as text."""
    pairs = [f.split(":") for f in (a, b)]
    return overlap(*[unpacked(int(n), base64.b64decode(bits)) for n, bits in pairs])


def fit_rarity(docs: DataFrame, text: str = "text") -> list[int]:
    """Windows of all texts by level: LEVELS numbers, whatever the input. They can be kept
    to make fingerprints of other tables comparable."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LEVELS, "int64")
        for batch in batches:
            for piece in _pieces(batch, "_t"):
                total += level_counts([t.encode() for t in piece.column("_t").to_pylist() if t])
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"level": pa.array(seen, pa.int64()), "n": pa.array(total[seen])})

    rows = docs.select(F.col(text).alias("_t")).mapInArrow(count, "level bigint, n bigint")
    found = dict(rows.groupBy("level").agg(F.sum("n")).collect())
    return [found.get(level, 0) for level in range(LEVELS)]


def _pieces(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """The batch cut so that a piece has about PIECE_BYTES of text."""
    column = batch.column(batch.schema.get_field_index(text))
    lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    start, size = 0, 0
    for i, n in enumerate(lengths):
        size += n
        if size >= PIECE_BYTES or i + 1 == len(lengths):
            yield batch.slice(start, i + 1 - start)
            start, size = i + 1, 0


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by the start of the following one."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


Filters = tuple[int, bytes]


def _report(
    rank: np.ndarray, keys: list, texts: list[str], known: list[Filters | None]
) -> tuple[dict, list[Filters]]:
    """Columns of all texts but the last, which only follows; and the fingerprints of all."""
    changed = [edited(a, b) for a, b in zip(texts, texts[1:])]
    fresh = [t.encode() for t, f in zip(texts, known) if f is None]
    marks = make_filters(fresh + [t.encode() for t in changed], rank)
    made = iter(marks[: len(fresh)])
    own = [f or next(made) for f in known]
    edits = marks[len(fresh) :]
    bits = [unpacked(*f) for f in own]
    columns = {
        "key": keys,
        "n_chars": [len(t) for t in texts[:-1]],
        "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in changed],
        "own": [_struct(f) for f in own[:-1]],
        "edit": [_struct(f) for f in edits],
        "near_edited": [overlap(a, unpacked(*b)) for a, b in zip(bits, edits)],
        "near_next": [overlap(a, b) for a, b in zip(bits, bits[1:])],
    }
    return columns, own


def _struct(filters: Filters) -> dict:
    return {"n": filters[0], "bits": filters[1]}


def _as_text(filters: str) -> Column:
    coded = F.translate(F.base64(F.col(filters)["bits"]), "\r\n", "")
    return F.concat(F.col(filters)["n"].cast("string"), F.lit(":"), coded)


def fingerprint_report(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    counts: list[int] | None = None,
) -> DataFrame:
    """key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Documents follow one another by (key, hash of the text), a null key first; the first
    follows the last, and a lone document itself. Equal rows are documents of their own. A
    null text counts as empty. ``counts`` are those of ``fit_rarity``, by default of these
    documents. An empty table gives no rows; other columns are left out.

    Texts are shuffled once, into ranges of that order. A task streams through its range and
    holds a few MB of texts, or one longer text. The last text of a range waits for the first
    of the next one: one pair of texts a range.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rank = rarity(np.array(fit_rarity(rows) if counts is None else counts, "int64"))
    order = ["key", "mark", "seq"]
    rows = rows.select(
        "*", F.xxhash64("text").alias("mark"), F.monotonically_increasing_id().alias("seq")
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranged = ranged.select("key", "text", F.spark_partition_id().alias("part"))
    kind = rows.schema["key"].dataType.simpleString()
    made = "struct<n: bigint, bits: binary>"
    schema = (
        f"key {kind}, n_chars bigint, edited_sha256 string, near_edited double, "
        f"near_next double, own {made}, edit {made}"
    )
    names = ["key", "n_chars", "edited_sha256", "near_edited", "near_next", "own", "edit"]
    outer = f"{schema}, part int, head string, tail string"

    def batch_of(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
        n = len(columns["key"])
        return pa.RecordBatch.from_arrays(
            [pa.array(columns.get(f.name, [None] * n), f.type) for f in schema], schema=schema
        )

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = head = part = kinds = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if kinds is None:
                kinds = _arrow(batch.schema.field("key").type)
                head, part = batch.column("text")[0].as_py(), batch.column("part")[0].as_py()
            for piece in _pieces(batch, "text"):
                keys, texts = piece.column("key").to_pylist(), piece.column("text").to_pylist()
                known = [None] * len(texts)
                if held:
                    keys, texts, known = [held[0], *keys], [held[1], *texts], [held[2], *known]
                columns, own = _report(rank, keys[:-1], texts, known)
                held = (keys[-1], texts[-1], own[-1])
                yield batch_of(columns, kinds)
        if held:
            waiting = {"key": [held[0]], "own": [_struct(held[2])]}
            waiting |= {"part": [part], "head": [head], "tail": [held[1]]}
            yield batch_of(waiting, kinds)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = pa.schema([f for f in _arrow(batch.schema.field("key").type) if f.name in names])
            for row in batch.to_pylist():
                known = (row["own"]["n"], row["own"]["bits"])
                columns, _ = _report(rank, [row["key"]], [row["tail"], row["head"]], [known, None])
                yield batch_of(columns, kinds)

    done = settle(ranged.mapInArrow(stream, outer))
    tails = done.filter(F.col("part").isNotNull())
    # numbers of the ranges that have rows, each with that of the next
    numbers = tails.select("part")
    in_order = Window.orderBy("part")
    whole = in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    numbers = numbers.select(
        "part", F.coalesce(F.lead("part").over(in_order), F.min("part").over(whole)).alias("next")
    )
    heads = tails.select(F.col("part").alias("next"), "head")
    pairs = tails.drop("head").join(numbers, "part").join(heads, "next")
    last = pairs.select("key", "tail", "head", "own").mapInArrow(finish, schema)
    finished = done.filter(F.col("part").isNull()).select(*names)
    return finished.unionByName(last).select(
        F.col("key").alias(key),
        "n_chars",
        "edited_sha256",
        _as_text("own").alias("fingerprint"),
        _as_text("edit").alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def _arrow(key: pa.DataType) -> pa.Schema:
    made = pa.struct([("n", pa.int64()), ("bits", pa.binary())])
    return pa.schema(
        [
            ("key", key),
            ("n_chars", pa.int64()),
            ("edited_sha256", pa.string()),
            ("near_edited", pa.float64()),
            ("near_next", pa.float64()),
            ("own", made),
            ("edit", made),
            ("part", pa.int32()),
            ("head", pa.string()),
            ("tail", pa.string()),
        ]
    )

"""Benchmark decontamination: a prefix-filtered join of documents with benchmark windows.

An item's window is a set of neighbouring words, and a document holds it only if it holds all
of the window's shingles. So one shingle, the rarest in the documents, is a sufficient prefix
of each window: documents and windows are joined on it, the place in the window bounds where
it can lie in the document (position and length), and the whole window is then compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import map_texts
from tallyfold.llm.shingles import FACTOR, mixed, ngram_hashes
from tallyfold.operators.skew import lookup_join
from tallyfold.sources.shared import settle

WINDOW = 10
SHINGLE = 3
BLOCK_WINDOWS = 500_000
PIECE_BYTES = 1 << 19
SPAN = 1 << 15
LONG_WORD = 1 << 10
MAX_MARKS = 1 << 24

SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
UPPER = bytes(range(0x41, 0x5B))
TO_SPACES = bytes(
    b + 32 if b in UPPER else 32 if b in SEPARATORS else b for b in range(256)
)


VALUES = mixed(np.arange(1, 257, dtype=np.uint64))
POWERS = np.cumprod(np.full(SPAN + LONG_WORD, FACTOR, np.uint64))
INVERSES = np.cumprod(np.full(SPAN, pow(FACTOR, -1, 1 << 64), np.uint64))


def bytes_of(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def words_of(text: str | None) -> list[bytes]:
    """A-Z lowered, then runs of what is neither a control, a blank nor an ASCII mark."""
    return bytes_of(text).translate(TO_SPACES).split()


class Texts:
    """The words of several texts, as places in their bytes, and the words' hashes.

    The words of text i are those from ``first[i]`` to ``first[i + 1]``. A hash is the sum of
    the values of a word's bytes times powers of a factor, taken from running sums, so all
    words are hashed at once. Beyond ``LONG_WORD`` bytes a word is not looked at: equal words
    have equal hashes, and what has equal hashes must be compared.
    """

    def __init__(self, texts: list[str | None]):
        encoded = [bytes_of(t) for t in texts]
        # a blank after each text ends its last word
        self.data = b" ".join([*encoded, b""]).translate(TO_SPACES)
        self.bounds = np.cumsum([0, *[len(t) + 1 for t in encoded]])
        data = np.frombuffer(self.data, np.uint8)
        inside = np.zeros(len(data) + 1, np.int8)
        inside[1:] = data != 32
        edges = np.flatnonzero(np.diff(inside))
        starts, ends = edges[::2], edges[1::2]
        self.first = np.searchsorted(starts, self.bounds)
        self.hashes = np.empty(len(starts), np.uint64)
        cuts = np.searchsorted(starts, np.arange(0, len(data) + SPAN, SPAN)).tolist()
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            part = data[k * SPAN : (k + 1) * SPAN + LONG_WORD]
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(VALUES[part] * POWERS[: len(part)], out=sums[1:])
            begin = starts[a:b] - k * SPAN
            end = np.minimum(ends[a:b] - k * SPAN, begin + LONG_WORD)
            self.hashes[a:b] = (sums[end] - sums[begin]) * INVERSES[begin]

    def words(self, i: int) -> list[bytes]:
        return self.data[self.bounds[i] : self.bounds[i + 1]].split()

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


class Keys:
    """Sorted keys that are looked for among the runs of ``size`` words of texts."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = max(16, min(int(MAX_MARKS).bit_length() - 1, (8 * len(keys)).bit_length()))
        self.shift = np.uint64(64 - bits)
        self.marks = np.zeros(1 << bits, bool)
        self.marks[keys.view(np.uint64) >> self.shift] = True

    def met(self, texts: Texts, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Texts, words at which runs begin in all texts, and keys' numbers, of runs that are keys."""
        grams = ngram_hashes(texts.hashes, size)
        # most runs are no key, and the marks rule them out
        at = np.flatnonzero(self.marks[grams >> self.shift])
        grams = grams[at].view(np.int64)
        key = np.searchsorted(self.keys, grams)
        own = np.searchsorted(texts.first, at, "right") - 1
        # a run must not go on into the next text
        good = at + size <= texts.first[own + 1]
        good[good] = self.keys[np.minimum(key[good], len(self.keys) - 1)] == grams[good]
        return own[good], at[good], key[good]


def windows_of(text: str | None, size: int) -> list[list[bytes]]:
    words = words_of(text)
    if not words:
        return []
    return [words[i : i + size] for i in range(max(1, len(words) - size + 1))]


def window_table(benchmark: DataFrame, text: str, key: str, window: int, shingle: int) -> DataFrame:
    """key, the window's words, the words in a shingle, and the hashes of its shingles; equal
    windows of an item once, from however many of its rows they come."""

    def cut(texts):
        out = []
        for t in texts:
            hashes = Texts([t]).hashes
            found = {}
            for i, w in enumerate(windows_of(t, window)):
                size = min(shingle, len(w))
                parts = ngram_hashes(hashes[i : i + len(w)], size).view(np.int64).tolist()
                found[b" ".join(w)] = {"words": b" ".join(w), "size": size, "parts": parts}
            out.append(list(found.values()))
        kind = pa.list_(
            pa.struct([("words", pa.binary()), ("size", pa.int32()), ("parts", pa.list_(pa.int64()))])
        )
        return {"found": pa.array(out, kind)}

    rows = benchmark.select(F.col(key).cast("string").alias("item"), F.col(text).alias("text"))
    schema = "found array<struct<words:binary,size:int,parts:array<bigint>>>"
    found = map_texts(rows.filter("item is not null"), "text", schema, cut)
    listed = found.select("item", F.explode("found").alias("w")).select("item", "w.words", "w.size", "w.parts")
    return listed.dropDuplicates(["item", "words"])


class Windows:
    """A block of windows, by the hash of their rarest shingle.

    ``keys`` is sorted; the windows of a key stand at ``first`` to ``first`` + ``n``, each
    with its words, the shingle's place, and its items.
    """

    def __init__(self, rows: list[tuple[int, int, bytes, list[str]]], shingle: int = SHINGLE):
        rows = sorted(rows, key=lambda r: (r[0], r[2]))
        self.rows = [(place, words.split(), items) for _, place, words, items in rows]
        keys, self.first, self.n = np.unique(
            np.array([r[0] for r in rows], np.int64), return_index=True, return_counts=True
        )
        self.keys = Keys(keys)
        self.sizes = sorted({min(shingle, len(words)) for _, words, _ in self.rows})

    def find(self, texts: Texts) -> dict[int, tuple[list[tuple[int, int]], set[str]]]:
        """By the number of the text: places (from, to) of all windows in its words, and the
        items they belong to. Only texts that hold a window are listed."""
        found, words, own = {}, None, None
        met = [np.concatenate(c) for c in zip(*[self.keys.met(texts, size) for size in self.sizes])]
        order = np.argsort(met[0], kind="stable") if met else []
        for t, at, key in zip(*[c[order].tolist() for c in met]):
            if t != own:
                own, words, begin = t, texts.words(t), int(texts.first[t])
            first = self.first[key]
            for place, window, items in self.rows[first : first + self.n[key]]:
                start = at - begin - place
                # the place in the window and its length say where it must lie
                if start >= 0 and start + len(window) <= len(words) and words[start : start + len(window)] == window:
                    places, own_items = found.setdefault(t, ([], set()))
                    places.append((start, start + len(window)))
                    own_items.update(items)
        return found


def _blocks(windows: DataFrame, n_windows: int, limit: int) -> Iterator[list]:
    """The windows, ``limit`` or so at a time, cut by a hash."""
    n_blocks = max(1, -(-n_windows // limit))
    block = F.pmod(F.xxhash64("words"), F.lit(n_blocks))
    for b in range(n_blocks):
        rows = windows.filter(block == b).groupBy("rarest", "place", "words").agg(F.sort_array(F.collect_set("item")).alias("items"))
        yield [(r["rarest"], r["place"], bytes(r["words"]), r["items"]) for r in rows.collect()]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[Texts]:
    """The texts of the first column, about ``PIECE_BYTES`` at a time."""
    held, size = [], 0
    for batch in batches:
        for t in batch.column(0):
            held.append(t.as_py())
            size += len(held[-1] or "")
            if size >= PIECE_BYTES:
                yield Texts(held)
                held, size = [], 0
    yield Texts(held)


def rarity(docs: DataFrame, text: str, shingles: DataFrame, sizes: list[int]) -> DataFrame:
    """How often each shingle of the benchmark (column ``part``) occurs in the documents.

    The benchmark's shingles go to the tasks as a sorted array in blocks of bounded size, one
    after the other; a task sends back its counts of those it has met.
    """
    spark = docs.sparkSession
    total = shingles.count()
    n_blocks = max(1, -(-total // (8 * BLOCK_WINDOWS)))
    found = None
    for b in range(n_blocks):
        rows = shingles.filter(F.pmod(F.xxhash64("part"), F.lit(n_blocks)) == b).toPandas()
        shared = spark.sparkContext.broadcast((np.sort(rows["part"].to_numpy(np.int64)), sizes))

        def counted(batches, shared=shared):
            keys, sizes = shared.value
            looked_for = Keys(keys)
            n = np.zeros(len(keys), np.int64)
            for texts in _pieces(batches):
                for size in sizes:
                    np.add.at(n, looked_for.met(texts, size)[2], 1)
            met = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"part": keys[met], "n": n[met]})

        part = docs.select(F.col(text)).mapInArrow(counted, "part bigint, n bigint")
        if n_blocks > 1:
            part = settle(part)
            shared.destroy()
        found = part if found is None else found.unionByName(part)
    return found.groupBy("part").agg(F.sum("n").alias("n"))


def _digest(items) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def _block_hits(texts: DataFrame, block) -> DataFrame:
    """id, ends, items of the texts that hold a window of the block, equal texts once.
    ``ends``: where the runs of words inside windows begin and end, in turn."""

    def met(texts):
        made = Texts(texts)
        found = block.value.find(made)
        ends, items = [], []
        for i, n in enumerate(made.counts().tolist()):
            places, own = found.get(i, ([], ()))
            hit = np.zeros(n + 2 if places else 0, np.int64)
            for a, b in places:
                hit[a + 1] += 1
                hit[b + 1] -= 1
            ends.append(np.flatnonzero(np.diff(np.cumsum(hit) > 0)))
            items.append(sorted(own))
        return {"ends": pa.array(ends, pa.list_(pa.int64())), "items": pa.array(items, pa.list_(pa.string()))}

    hits = map_texts(texts, "text", "ends array<bigint>, items array<string>", met, PIECE_BYTES)
    return hits.filter("size(items) > 0").dropDuplicates(["id"])


def _added_up(hits: DataFrame) -> DataFrame:
    """id, n_hit, n_items, items_sha256 of the texts, from what all blocks found in them."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_hit, n_items, digest = [], [], []
            for runs, found in zip(batch.column(1), batch.column(2)):
                n = upto = 0
                for a, b in sorted((v[i], v[i + 1]) for v in runs.as_py() for i in range(0, len(v), 2)):
                    n += max(0, b - max(a, upto))
                    upto = max(upto, b)
                items = {i for v in found.as_py() for i in v}
                n_hit.append(n)
                n_items.append(len(items))
                digest.append(_digest(items))
            made = [pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(digest, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], ["id", "n_hit", "n_items", "items_sha256"])

    by_text = hits.groupBy("id").agg(F.collect_list("ends"), F.collect_list("items"))
    return by_text.mapInArrow(added, "id string, n_hit bigint, n_items bigint, items_sha256 string")


def _block_by_block(docs: DataFrame, text: str, blocks: Iterator[list], shingle: int) -> DataFrame:
    """As ``decontaminate``, for more windows than a block: each block is broadcast, met by
    all texts and released before the next one is collected."""
    spark = docs.sparkSession
    named = F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    texts = docs.select(named.alias("id"), F.col(text).alias("text"))
    hits = None
    for rows in blocks:
        block = spark.sparkContext.broadcast(Windows(rows, shingle))
        found = settle(_block_hits(texts, block))
        block.destroy()
        hits = found if hits is None else hits.unionByName(found)

    def counted(texts):
        return {"n_words": pa.array(Texts(texts).counts(), pa.int64())}

    rows = map_texts(docs.withColumn("_hit_id", named), text, "n_words bigint", counted, PIECE_BYTES)
    found = _added_up(hits).withColumnRenamed("id", "_hit_id")
    joined = lookup_join(
        rows.withColumn("_hit_row", F.monotonically_increasing_id()), found, ["_hit_id"], ["_hit_row"], weight=None
    )
    n_hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    return joined.select(
        *[c for c in docs.columns if c != text],
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("bigint")).alias("n_items"),
        F.coalesce("items_sha256", F.lit(_digest([]))).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    bench_text: str = "text",
    bench_key: str = "item_id",
    window: int = WINDOW,
    shingle: int = SHINGLE,
    block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """Replace the text by n_words, n_hit, n_items, items_sha256 and contaminated.

    ``n_hit``: words inside any occurrence of a window of ``window`` words of an item (of all
    its words, if it has fewer). ``items_sha256``: hex of the items' ids with occurring
    windows, sorted as text and joined by commas (of "" if there are none). Null and empty
    texts, of documents and items, have no words; items without id are left out; repeated
    rows count alike. The benchmark goes to the tasks in blocks of ``block_windows`` windows,
    one at a time, so neither the driver nor a task ever holds more; each document meets all
    blocks, so any number of items gives whole results.
    """
    spark = docs.sparkSession
    windows = settle(window_table(benchmark, bench_text, bench_key, window, shingle))
    parts = windows.select(F.explode("parts").alias("part")).distinct()
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())
    counts = rarity(docs, text, parts, sizes)
    by_window = windows.select("item", "words", F.posexplode("parts").alias("place", "part"))
    rarest = settle(
        by_window.join(counts, "part")
        .groupBy("item", "words")
        .agg(F.min(F.struct("n", "part", "place")).alias("r"), F.count(F.lit(1)).alias("met"))
        .join(windows.select("item", "words", F.size("parts").alias("all")), ["item", "words"])
        # a shingle that no document has rules its window out
        .filter(F.col("met") == F.col("all"))
        .select("item", "words", F.col("r.part").alias("rarest"), F.col("r.place").alias("place"))
    )
    n_windows = rarest.count()
    blocks = _blocks(rarest, n_windows, block_windows)
    if n_windows > block_windows:
        return _block_by_block(docs, text, blocks, shingle)
    block = spark.sparkContext.broadcast(Windows(next(blocks), shingle))
    none = _digest([])

    def checked(texts):
        made = Texts(texts)
        found = block.value.find(made)
        n_words = made.counts()
        n_hit, n_items, digest = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), [none] * len(texts)
        for i, (places, items) in found.items():
            hit = np.zeros(n_words[i] + 1, np.int64)
            for a, b in places:
                hit[a] += 1
                hit[b] -= 1
            n_hit[i] = (np.cumsum(hit) > 0).sum()
            n_items[i] = len(items)
            digest[i] = _digest(items)
        return {
            "n_words": pa.array(n_words, pa.int64()),
            "n_hit": pa.array(n_hit, pa.int64()),
            "n_items": pa.array(n_items, pa.int64()),
            "items_sha256": pa.array(digest, pa.string()),
            "contaminated": pa.array(n_hit > 0, pa.bool_()),
        }

    schema = "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"
    return map_texts(docs, text, schema, checked, PIECE_BYTES)


def keep_clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows, with their columns, that hold no window of the benchmark."""
    copy = "_text"
    while copy in docs.columns:
        copy += "_"
    rows = docs.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(docs.columns)], F.col(text).alias("_text"))
    checked = decontaminate(rows, benchmark, "_text")
    return checked.filter("not contaminated").select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns)])

"""Near duplicates by the Jaccard similarity of word n-grams: a T-occurrence search.

Two sets of similarity t share at least T = ceil(t n) shingles with a set of size n. With a
set's shingles in order of rarity, a partner must share K of the first n - T + K (its
*prefix*). So only prefixes are shuffled, as inverted lists, one set for each group of copies.

- Short lists are merged by a join: pairs that meet in K of them, and whose places leave room
  for enough common shingles, are compared in full.
- Long lists belong to large groups of like texts. First each of their sets is searched for in
  a panel: a few sets, by a hash, of its longest list. What is linked so is connected already,
  and lists whose sets are all connected need no search. In each of the others, all sets are
  searched for among those outside its largest component, which are cut into blocks.

A task holds a panel or a block, reads the other sets past it, and searches by DivideSkip: a heap
merges the short lists of a query, the long ones are only probed, by bisection, for the sets that
survive. It returns a spanning forest of the links of each batch, so the number of rows doesn't
grow with the pairs in a group.

Whole sets are sent only where a *parity map* leaves room for a partner: two to four bits for each
shingle of a set, each telling whether an odd number of them fall on it. Bits in which two maps
differ stand for different shingles each, so more of them than a link allows rule it out.

Every pair either shares a long list (and is connected already or meets in its blocks) or none
(and meets in K short ones), so no component is missed, whatever the lengths of lists.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.llm.common import map_texts
from tallyfold.llm.components import components, forest
from tallyfold.llm.shingles import WordHashes, ngram_hashes
from tallyfold.operators.skew import lookup_join
from tallyfold.sources.shared import settle

SHINGLE = 4
PERCENT = 85
SKETCH_BITS = 18
COMMON = 4
SHORT_LIST = 16
PANEL = 64
BLOCK_SHINGLES = 1_000_000
BROADCAST_ROWS = 1_000_000
PROBED = 32


def words_of(text: str | None) -> list[bytes]:
    """A-Z lowered, cut at blanks and at U+0009 to U+000D."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted hashes of the distinct runs of ``n`` words; fewer words are one run."""
    words = words_of(text)
    return np.unique(ngram_hashes(WordHashes.shared()(words), min(n, len(words))))


def least_overlap(n: int, percent: int) -> int:
    """Shingles that a set of ``n`` shares with any partner."""
    return -(-percent * n // 100)


# --- rarity ------------------------------------------------------------------------------


def rarity_sketch(docs: DataFrame, text: str, n: int, bits: int) -> np.ndarray:
    """How many shingles of all documents fall on each of 2^bits hash buckets.

    It sets the order of shingles only; any order gives the same links. Tasks count their own
    documents and shuffle a row for each bucket they met.
    """

    def counted(batches):
        n_buckets = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for t in batch.column(0):
                own = shingle_set(t.as_py(), n) >> np.uint64(64 - bits)
                np.add.at(n_buckets, own.view(np.int64), 1)
        met = np.flatnonzero(n_buckets)
        yield pa.RecordBatch.from_pydict({"bucket": met.astype(np.int32), "n": n_buckets[met]})

    rows = (
        docs.select(text)
        .mapInArrow(counted, "bucket int, n bigint")
        .groupBy("bucket")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    sketch = np.zeros(1 << bits, np.int64)
    sketch[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return sketch


# --- the search in a task ----------------------------------------------------------------


class Lists:
    """Inverted lists of the sets of a block: for each shingle the sorted numbers of its sets."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        every = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(every, kind="stable")
        self.owner = owner[order]
        self.keys, self.first = np.unique(every[order], return_index=True)
        self.last = np.append(self.first[1:], len(every))
        # all lists as one sorted array of (list, set), for probing many lists at once
        self.cells = np.repeat(np.arange(len(self.keys)), self.last - self.first) * len(sets) + self.owner

    def search(self, query: np.ndarray, percent: int, common: int = COMMON) -> np.ndarray:
        """Numbers of the sets whose similarity to the query is ``percent`` at least."""
        if not len(query) or not len(self.keys):
            return np.empty(0, np.int64)
        at = np.searchsorted(self.keys, query)
        at[at == len(self.keys)] = 0
        at = at[self.keys[at] == query]
        need = least_overlap(len(query), percent)
        if len(at) < need:
            return np.empty(0, np.int64)
        length = self.last[at] - self.first[at]
        at = at[np.argsort(length, kind="stable")]
        # the longest lists are set aside; what occurs need times occurs `floor` times in the rest
        aside = max(0, need - min(common, need))
        floor = need - aside
        short, long = at[: len(at) - aside], at[len(at) - aside :]
        lists = [self.owner[self.first[i] : self.last[i]].tolist() for i in short.tolist()]
        sets, counts = np.unique(np.fromiter(heapq.merge(*lists), np.int64), return_counts=True)
        sets, counts = sets[counts >= floor], counts[counts >= floor]
        # a partner is neither too short nor too long
        fits = (100 * self.sizes[sets] >= percent * len(query)) & (100 * len(query) >= percent * self.sizes[sets])
        sets, counts = sets[fits], counts[fits]
        for start in range(0, len(long), PROBED):
            alive = counts + len(long) - start >= need
            sets, counts = sets[alive], counts[alive]
            if not len(sets):
                break
            wanted = long[start : start + PROBED, None] * len(self.sizes) + sets
            place = np.minimum(np.searchsorted(self.cells, wanted), len(self.cells) - 1)
            counts = counts + (self.cells[place] == wanted).sum(axis=0)
        return sets[100 * counts >= percent * (len(query) + self.sizes[sets] - counts)]


# --- parity maps -------------------------------------------------------------------------


def parity_map(hashes: np.ndarray) -> np.ndarray:
    """Two to four bits for each hash, 64 at least: which are hit by an odd number of hashes."""
    bits = max(64, 1 << (2 * len(hashes) - 1).bit_length())
    hits = np.bincount((hashes & np.uint64(bits - 1)).view(np.int64), minlength=bits)
    return np.packbits((hits & 1).astype(np.uint8), bitorder="little").view(np.uint64)


def most_apart(n: np.ndarray, m: int, percent: int) -> np.ndarray:
    """Shingles that are in one only of two linked sets of ``n`` and ``m``, at most."""
    return n + m - 2 * -(-percent * (n + m) // (100 + percent))


class Maps:
    """The parity maps of the sets of a block, those of one width as one table."""

    def __init__(self, nodes: list[int], sizes: list[int], maps: list[np.ndarray]):
        self.nodes, self.sizes = np.array(nodes, np.int64), np.array(sizes, np.int64)
        self.open = np.zeros(len(nodes), bool)
        width = np.array([len(m) for m in maps])
        self.tables = {
            int(w): (at := np.flatnonzero(width == w), np.stack([maps[i] for i in at])) for w in np.unique(width)
        }

    def any_partner(self, node: int, n: int, own: np.ndarray, percent: int) -> bool:
        """Whether a set may be linked with another one of the block; marks those as open."""
        found = False
        for width, (at, table) in self.tables.items():
            sizes = self.sizes[at]
            fits = (100 * sizes >= percent * n) & (100 * n >= percent * sizes) & (self.nodes[at] != node)
            if not fits.any():
                continue
            at, table = at[fits], table[fits]
            # of two widths the larger one is folded to the smaller
            least = min(width, len(own))
            mine = np.bitwise_xor.reduce(own.reshape(-1, least), axis=0)
            table = np.bitwise_xor.reduce(table.reshape(len(table), -1, least), axis=1)
            apart = np.bitwise_count(table ^ mine).sum(axis=1, dtype=np.int64)
            near = at[apart <= most_apart(self.sizes[at], n, percent)]
            self.open[near] = True
            found = found or len(near) > 0
        return found


# --- the join ----------------------------------------------------------------------------


def _made_again(
    nodes: DataFrame, docs: DataFrame, key: str, text: str, n: int, what: str, make: Callable[[np.ndarray], np.ndarray]
) -> DataFrame:
    """(node, n, ``what``) of the given nodes, ``make`` of the shingle sets of the texts that stand
    for them. Only where a node has several rows can two of them have its key and its text."""
    wanted = nodes.select("node", "copies", F.col("rep.key").alias("_key"), F.col("rep.text_key").alias("_text_key"))
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    rows = docs.select(F.col(key).alias("_id"), F.xxhash64(text).alias("_text"), F.col(text).alias("text"))
    chosen = rows.join(wanted, F.col("_id").eqNullSafe(F.col("_key")) & (F.col("_text") == F.col("_text_key")))
    once = chosen.filter("copies = 1").select("node", "text")
    several = chosen.filter("copies > 1").select("node", "text").dropDuplicates(["node"])

    def made(texts):
        own = [shingle_set(t, n) for t in texts]
        return {
            "n": pa.array([len(s) for s in own], pa.int64()),
            what: pa.array([make(s).tobytes() for s in own], pa.binary()),
        }

    return map_texts(once.union(several), "text", f"n bigint, {what} binary", made)


def _short_list_pairs(lists: DataFrame, percent: int, short: int) -> DataFrame:
    """Pairs (g, node, n of the node) that meet in enough short lists and can still be similar."""
    side = lists.filter(F.col("m") <= short).select("h", "node", "n", "pos")
    other = side.select("h", *[F.col(c).alias(f"{c}_b") for c in ("node", "n", "pos")])
    met = (
        side.join(other, "h")
        .filter(f"node < node_b and 100 * n >= {percent} * n_b and 100 * n_b >= {percent} * n")
        .groupBy("node", "node_b")
        .agg(
            F.count(F.lit(1)).alias("s"),
            F.first("n").alias("n"),
            F.first("n_b").alias("n_b"),
            F.max("pos").alias("pos"),
            F.max("pos_b").alias("pos_b"),
        )
    )
    need = F.ceil(percent * (F.col("n") + F.col("n_b")) / (100 + percent))
    room = F.least(F.col("n") - F.col("pos"), F.col("n_b") - F.col("pos_b")) - 1
    return met.filter((F.col("s") >= F.least(F.lit(COMMON), need)) & (F.col("s") + room >= need)).select(
        F.col("node").alias("g"), F.col("node_b").alias("node"), F.col("n_b").alias("n")
    )


def _panels(hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(g, node) of the panels, (g, node, n) of the sets to search for in them. A set is searched
    for in its longest list; a panel has no more sets than are searched for in it."""
    home = settle(
        hot.groupBy("node")
        .agg(F.max(F.struct("m", "h")).alias("list"), F.first("n").alias("n"))
        .select(F.col("list.h").alias("g"), "node", "n")
    )
    sought = home.groupBy("g").agg(F.count(F.lit(1)).alias("sought"))
    by_hash = Window.partitionBy("h").orderBy(F.xxhash64("node"), "node")
    ranked = hot.select("h", "node").withColumn("r", F.row_number().over(by_hash)).filter(F.col("r") <= PANEL)
    panels = ranked.withColumnRenamed("h", "g").join(sought, "g").filter("r <= sought").select("g", "node")
    return panels, home


def _sent(held: DataFrame, sought: DataFrame, sets: DataFrame, column: str, block_shingles: int) -> DataFrame:
    """(kind, g, part, side, node, n, ``column``): what a group holds (side 0), then what is sought
    there (side 1), sorted so.

    What is sought is dealt out in parts of about ``block_shingles`` shingles, and the sets held
    are sent to each part.
    """
    by = ["kind", "g"]
    parts = (
        sought.groupBy(*by)
        .agg(F.count(F.lit(1)).alias("n_rows"), F.ceil(F.sum(F.col("n") + 64) / block_shingles).alias("parts"))
        .filter("parts > 1")
    )
    part = F.pmod(F.xxhash64("node"), F.coalesce("parts", F.lit(1))).cast("int").alias("part")
    dealt = settle(lookup_join(sought, parts, by, ["node"]).select(*by, part, F.lit(1).alias("side"), "node"))
    sent = dealt.union(
        dealt.select(*by, "part").distinct().join(held, by).select(*by, "part", F.lit(0), "node")
    )
    key = [*by, "part"]
    return (
        sent.join(sets.select("node", "n", column), "node")
        .select(*key, "side", "node", "n", column)
        .repartition(*key)
        .sortWithinPartitions(*key, "side")
    )


def _sieved(
    held: DataFrame, sought: DataFrame, sets: DataFrame, percent: int, block_shingles: int
) -> tuple[DataFrame, DataFrame]:
    """Those of the sets (kind, g, node) and of the sets (kind, g, node, n) sought there whose
    parity maps leave room for a link in their group."""
    met = _sent(held, sought, sets, "parity", block_shingles)

    def sieved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, own, maps = None, [], None
        out: list[tuple] = []

        def end():
            if maps is not None:
                for i in np.flatnonzero(maps.open).tolist():
                    out.append((group[0], group[1], 0, int(maps.nodes[i]), int(maps.sizes[i])))

        def rows():
            kind, g, side, node, n = zip(*out) if out else ((),) * 5
            made = {"kind": pa.array(kind, pa.int32()), "g": pa.array(g, pa.int64()), "side": pa.array(side, pa.int32())}
            out.clear()
            return pa.RecordBatch.from_pydict(
                made | {"node": pa.array(node, pa.int64()), "n": pa.array(n, pa.int64())}
            )

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(6)]
            for kind, g, part, side, node, n, parity in zip(*columns, batch.column(6)):
                parity = np.frombuffer(parity.as_py(), np.uint64)
                if not side:
                    if (kind, g, part) != group:
                        end()
                        group, own, maps = (kind, g, part), [], None
                    own.append((node, n, parity))
                    continue
                maps = maps or Maps(*zip(*own))
                if maps.any_partner(node, n, parity, percent):
                    out.append((kind, g, 1, node, n))
            yield rows()
        end()
        yield rows()

    left = settle(met.mapInArrow(sieved, "kind int, g bigint, side int, node bigint, n bigint"))
    return (
        left.filter("side = 0").select("kind", "g", "node").distinct(),
        left.filter("side = 1").select("kind", "g", "node", "n"),
    )


def _searched(
    held: DataFrame,
    sought: DataFrame,
    maps: DataFrame,
    sets_of: Callable[[DataFrame], DataFrame],
    percent: int,
    block_shingles: int,
) -> DataFrame:
    """Links (a, b) between the sets (kind, g, node) and the sets (kind, g, node, n) of the same
    group, as a spanning forest of each batch. ``sets_of`` makes the whole sets of those nodes
    (node) that pass the sieve."""
    held, sought = _sieved(held, sought, maps, percent, block_shingles)
    sets = settle(sets_of(held.select("node").union(sought.select("node")).distinct()))
    met = _sent(held, sought, sets, "hashes", block_shingles)

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, own, nodes, lists = None, [], [], None
        for batch in batches:
            a, b = [], []
            keys = zip(*(batch.column(i).to_pylist() for i in range(3)))
            sides, names = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            for this, side, node, hashes in zip(keys, sides, names, batch.column(6)):
                if not side:
                    if this != group:
                        group, own, nodes, lists = this, [], [], None
                    own.append(np.frombuffer(hashes.as_py(), np.uint64))
                    nodes.append(node)
                    continue
                lists = lists or Lists(own)
                found = [nodes[i] for i in lists.search(np.frombuffer(hashes.as_buffer(), np.uint64), percent)]
                a += found
                b += [node] * len(found)
            kept = np.array(forest(np.array(a, np.int64), np.array(b, np.int64)), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(kept[:, 0]), pa.array(kept[:, 1])], ["a", "b"])

    return met.mapInArrow(searched, "a bigint, b bigint")


def _blocks(hot: DataFrame, block_shingles: int) -> DataFrame:
    """(node, block) for the nodes of long lists, those of one list and of one component near each
    other. A block has about ``block_shingles`` shingles, however many partitions the nodes
    come in."""
    nodes = hot.groupBy("node", "component").agg(F.max(F.struct("m", "h")).alias("list"), F.first("n").alias("n"))
    order = ("h", "component", "node")
    ordered = nodes.select("node", "n", "list.h", "component").repartitionByRange(*order).sortWithinPartitions(*order)

    def measured(batches):
        part, size = TaskContext.get().partitionId(), 0
        for batch in batches:
            upto = size + np.cumsum(batch.column(1).to_numpy(zero_copy_only=False) + 64)
            size = int(upto[-1]) if len(upto) else size
            yield pa.RecordBatch.from_pydict(
                {"node": batch.column(0), "part": pa.array([part] * len(upto), pa.int32()), "upto": pa.array(upto, pa.int64())}
            )

    placed = settle(ordered.select("node", "n").mapInArrow(measured, "node bigint, part int, upto bigint"))
    # one row for each partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("part")
        .agg(F.max("upto").alias("total"))
        .select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("start"))
    )
    block = F.floor((F.col("start") + F.col("upto")) / block_shingles)
    return settle(placed.join(F.broadcast(starts), "part").select("node", block.alias("block")))


def near_duplicates(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    shingle: int = SHINGLE,
    percent: int = PERCENT,
    sketch_bits: int = SKETCH_BITS,
    short_list: int = SHORT_LIST,
    block_shingles: int = BLOCK_SHINGLES,
) -> DataFrame:
    """key, text_key (xxhash64 of the text), n_shingles, component_id for every row.

    ``component_id``: the least key of the rows reached by links of similarity ``percent`` /
    100 or more, the row itself included. Texts that are null or without words have no
    shingles and link with nothing. Rows with equal texts link, also if they have the same
    key; a null key is never the least, so a component of null keys alone has a null id.
    ``short_list`` and ``block_shingles`` set where a pair is found, never whether it is
    connected.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("text_key"), F.col(text).alias("text"))
    order = spark.sparkContext.broadcast(rarity_sketch(rows, "text", shingle, sketch_bits))

    def prefixed(texts):
        sizes, digests, prefixes = [], [], []
        for t in texts:
            own = shingle_set(t, shingle)
            n = len(own)
            sizes.append(n)
            digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if n else None)
            rare = order.value[(own >> np.uint64(64 - sketch_bits)).view(np.int64)]
            first = min(n, n - least_overlap(n, percent) + COMMON)
            prefixes.append(own[np.lexsort((own, rare))[:first]].view(np.int64))
        return {
            "n": pa.array(sizes, pa.int64()),
            "digest": pa.array(digests, pa.binary()),
            "prefix": pa.array(prefixes, pa.list_(pa.int64())),
        }

    sets = settle(map_texts(rows, "text", "n bigint, digest binary, prefix array<bigint>", prefixed))
    nodes = settle(
        sets.filter("digest is not null")
        .groupBy("digest")
        .agg(
            F.min("key").alias("least"),
            F.max(F.struct("key", "text_key")).alias("rep"),
            F.first("n").alias("n"),
            F.first("prefix").alias("prefix"),
            F.count(F.lit(1)).alias("copies"),
        )
        .withColumn("node", F.monotonically_increasing_id())
    )
    postings = nodes.select("node", "n", F.posexplode("prefix").alias("pos", "h"))
    lengths = postings.groupBy("h").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    lists = settle(postings.join(lengths, "h"))

    def kind(k: int, df: DataFrame, *columns) -> DataFrame:
        return df.select(F.lit(k).alias("kind"), *columns)

    hot = lists.filter(F.col("m") > short_list)
    pairs = settle(_short_list_pairs(lists, percent, short_list))
    panels, home = _panels(hot)
    held = kind(0, pairs.select("g").distinct(), "g", F.col("g").alias("node")).union(kind(1, panels, "g", "node"))
    sought = kind(0, pairs, "g", "node", "n").union(kind(1, home, "g", "node", "n"))
    needed = pairs.select("node").union(pairs.select("g")).union(home.select("node")).distinct()

    def again(wanted: DataFrame, what: str, make: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
        return _made_again(nodes.join(wanted, "node", "left_semi"), rows, "key", "text", shingle, what, make)

    def sets_of(wanted: DataFrame) -> DataFrame:
        return again(wanted, "hashes", np.asarray)

    maps = settle(again(needed, "parity", parity_map))
    tied = components(_searched(held, sought, maps, sets_of, percent, block_shingles))

    # lists whose sets aren't connected yet, with the largest component of each
    member = hot.select("h", "m", "node", "n").join(tied, "node", "left")
    member = settle(member.withColumn("component", F.coalesce("component", "node")))
    largest = (
        member.groupBy("h", "component")
        .agg(F.count(F.lit(1)).alias("c"))
        .groupBy("h")
        .agg(F.max(F.struct("c", "component"))["component"].alias("largest"), F.count(F.lit(1)).alias("k"))
        .filter("k > 1")
        .drop("k")
    )
    rest = settle(member.join(largest, "h"))
    outside = rest.filter("component != largest")

    # of two sets of a list that aren't connected, one is held in a block; the other is sought
    # there, and if both are held, that of the later block in the earlier one
    blocks = _blocks(outside, block_shingles)
    placed = settle(rest.join(blocks, "node", "left"))
    reached = (
        placed.filter("block is not null")
        .groupBy("h", F.col("block").alias("g"))
        .agg(F.min("component").alias("least"), F.max("component").alias("most"))
    )
    apart = "(least < most or least != component) and (block is null or block >= g)"
    sought = settle(kind(2, placed.join(reached, "h").filter(apart), "g", "node", "n").distinct())
    held = kind(2, blocks, F.col("block").alias("g"), "node")
    by_block = _searched(held, sought, maps, sets_of, percent, block_shingles)
    tied = components(tied.select(F.col("node").alias("a"), F.col("component").alias("b")).union(by_block))

    label = (
        nodes.select("node", "least")
        .join(tied, "node")
        .groupBy("component")
        .agg(F.min("least").alias("component_id"))
    )
    by_digest = (
        nodes.select("digest", "node", "least")
        .join(tied.join(label, "component").select("node", "component_id"), "node", "left")
        .select("digest", F.coalesce("component_id", "least").alias("component_id"))
    )
    return (
        sets.select("key", "text_key", "n", "digest")
        .join(by_digest, "digest", "left")
        .select(
            F.col("key").alias(key),
            "text_key",
            F.col("n").alias("n_shingles"),
            F.when(F.col("digest").isNull(), F.col("key")).otherwise(F.col("component_id")).alias("component_id"),
        )
    )


def keep_one(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT
) -> DataFrame:
    """One row of each component (of links of ``percent`` / 100 or more on runs of ``shingle``
    words), that with its id, and all rows without shingles, each with the columns of
    ``docs``. Of rows with equal key and text one stays. In a component of
    null keys alone, one row stays for each text."""
    found = near_duplicates(docs, key, text, shingle, percent)
    kept = (
        found.filter(F.col("n_shingles") == 0)
        .select(key, "text_key")
        .union(
            found.filter("n_shingles > 0")
            .filter(F.col("component_id").eqNullSafe(F.col(key)))
            .groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("text_key")))
            .agg(F.min(F.struct(key, "text_key")).alias("r"))
            .select(f"r.{key}", "r.text_key")
        )
        .distinct()
        .select(F.col(key).alias("_kept"), F.col("text_key").alias("_kept_text"))
    )
    # the row goes along as one value, so none of its columns can be taken for one of these
    marked = docs.select(F.struct("*").alias("_row"), F.col(key).alias("_key"), F.xxhash64(text).alias("_text_key"))
    return (
        marked.join(kept, F.col("_key").eqNullSafe(F.col("_kept")) & (F.col("_text_key") == F.col("_kept_text")))
        .dropDuplicates(["_key", "_text_key"])
        .select("_row.*")
    )


def jaccard_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id."""
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id")

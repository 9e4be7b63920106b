"""Near-duplicate embeddings by product quantisation.

Unit vectors go to the inverted list of their nearest coarse centroid; the rest is coded by
one codeword for each subspace. A query probes every list whose cell a vector in reach is
likely to lie in; there it adds up table entries for the codes (asymmetric distance). A
vector's code error bounds its true distance, so no vector within reach is lost in a probed
list; what is left is compared exactly, by cosine in double precision.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import hash_share
from tallyfold.llm.components import components, forest
from tallyfold.sources.shared import settle

THRESHOLD = 0.95
TRAIN_VECTORS = 16_384
MOST_LISTS = 1024
SUBSPACES = 8
CODEWORDS = 64
SPREAD = 3.0
BLOCK = 4096
CELLS = 2_000_000
ROUNDING = 1e-6
TRIED = 2048
PAIRS_EACH = 64
FOUND = 0.995


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = (x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1)
    best = d.argmin(1)
    return best, np.maximum(d[np.arange(len(x)), best], 0)


def k_means(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    k = min(k, len(x))
    centres = x[np.random.default_rng(7).choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        best, _ = _nearest(x, centres)
        n = np.bincount(best, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, best, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


@dataclass
class Index:
    """Coarse centroids and the subspaces' codewords, for unit vectors of one length."""

    centres: np.ndarray
    words: list[np.ndarray]
    cuts: list[slice]

    @property
    def length(self) -> int:
        return self.centres.shape[1]

    def encode(self, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and the distance between each vector and what its code stands for."""
        rest = x - self.centres[home]
        codes, error = np.empty((len(x), len(self.cuts)), np.uint8), np.zeros(len(x))
        for s, cut in enumerate(self.cuts):
            codes[:, s], d = _nearest(rest[:, cut], self.words[s])
            error += d
        return codes, np.sqrt(error)

    def probes(self, x: np.ndarray, home: np.ndarray, reach: np.ndarray) -> list[np.ndarray]:
        """Lists to look into: those whose cell is no further than ``reach`` (of the vector's
        list and the other) along the line between the centroids (the bisector's distance)."""
        d = (x**2).sum(1)[:, None] - 2 * x @ self.centres.T + (self.centres**2).sum(1)
        apart = np.sqrt(np.maximum(((self.centres[:, None] - self.centres) ** 2).sum(2), 1e-18))
        away = (d - d[np.arange(len(x)), home][:, None]) / (2 * apart[home])
        away[np.arange(len(x)), home] = 0
        return [np.flatnonzero(row <= far).astype(np.int32) for row, far in zip(away, reach[home])]

    def distances(self, queries: np.ndarray, which: int, codes: np.ndarray) -> np.ndarray:
        """Squared asymmetric distances between queries and coded vectors of a list."""
        rest = queries - self.centres[which]
        total = np.zeros((len(queries), len(codes)), np.float32)
        for s, cut in enumerate(self.cuts):
            part, words = rest[:, cut], self.words[s]
            table = (part**2).sum(1)[:, None] - 2 * part @ words.T + (words**2).sum(1)
            total += table.astype(np.float32)[:, codes[:, s]]
        return total


def train(sample: np.ndarray, lists: int, subspaces: int = SUBSPACES, codewords: int = CODEWORDS) -> Index:
    centres = k_means(sample, lists)
    home, _ = _nearest(sample, centres)
    rest = sample - centres[home]
    edges = np.linspace(0, sample.shape[1], min(subspaces, sample.shape[1]) + 1).astype(int)
    cuts = [slice(a, b) for a, b in zip(edges, edges[1:])]
    return Index(centres, [k_means(rest[:, cut], codewords) for cut in cuts], cuts)


def _unit(rows) -> tuple[np.ndarray, np.ndarray]:
    """Vectors in double precision and scaled to length 1."""
    x = np.array(list(map(np.asarray, rows)), np.float64)
    # scaled first, so that squares of very large or small components don't leave the range
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x, x / np.sqrt((x**2).sum(axis=1, keepdims=True))


def usable(vector: str = "embedding"):
    """Not null or empty, without null or non-finite components, not all zero."""
    v = F.col(vector)
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda c: c != 0), F.lit(False))


def sampled_pairs(x: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of linked vectors: for each of up to ``TRIED`` of them, up to ``PAIRS_EACH``."""
    dice = np.random.default_rng(11)
    tried = dice.choice(len(x), min(TRIED, len(x)), replace=False)
    a, b = [], []
    for start in range(0, len(tried), 256):
        part = tried[start : start + 256]
        for i, row in zip(part, x[part] @ x.T >= threshold):
            near = np.flatnonzero(row)
            near = near[near != i]
            near = dice.choice(near, PAIRS_EACH, replace=False) if len(near) > PAIRS_EACH else near
            a.append(np.full(len(near), i))
            b.append(near)
    return np.concatenate(a), np.concatenate(b)


def reaches(index: Index, x: np.ndarray, threshold: float, spread: float) -> np.ndarray:
    """How far beyond its cell a vector of list i looks for partners in list j.

    A partner at the threshold is as far away as ``whole``, and no bisector between them is
    further. Along one line a random displacement has the share of ``whole`` that its variance
    has there: that of an even spread over all dimensions, of the sample around its centroids,
    or of the sampled linked pairs, whichever is most. ``spread`` of these standard deviations
    are probed, or more, until ``FOUND`` of the sampled pairs meet; ``whole`` is the limit.
    """
    whole = float(np.sqrt(2 - 2 * threshold))
    centres = index.centres
    home, _ = _nearest(x, centres)
    a, b = sampled_pairs(x, threshold)
    apart = _squares_between(centres @ centres.T)
    share = np.full(apart.shape, 1 / index.length)
    for of, to, n in ((lambda v: x[v], lambda v: centres[home[v]], len(x)), (lambda v: x[a[v]], lambda v: x[b[v]], len(a))):
        square = np.zeros((index.length, index.length))
        for v in _slices(n):
            moved = of(v) - to(v)
            square += moved.T @ moved
        if (total := np.trace(square)) > 0:
            along = _squares_between(centres @ (square / total) @ centres.T)
            share = np.maximum(share, along / np.maximum(apart, 1e-18))
    # the line between centroids that are next to equal is not known
    deviation = np.where(apart > 1e-9, whole * np.sqrt(share), whole)
    if len(a):

        def wanted(p, q):
            to, own = centres[home[q]], centres[home[p]]
            away = (((x[p] - to) ** 2).sum(1) - ((x[p] - own) ** 2).sum(1)) / 2
            away /= np.sqrt(np.maximum(((to - own) ** 2).sum(1), 1e-18))
            return np.where(home[p] == home[q], 0.0, away / deviation[home[p], home[q]])

        # either end may find the other
        least = [np.minimum(wanted(a[v], b[v]), wanted(b[v], a[v])) for v in _slices(len(a))]
        spread = max(spread, float(np.quantile(np.concatenate(least), FOUND, method="higher")))
    return np.minimum(spread * deviation, whole) + ROUNDING


def _slices(n: int, size: int = 2048) -> list[slice]:
    return [slice(start, start + size) for start in range(0, n, size)]


def _squares_between(products: np.ndarray) -> np.ndarray:
    own = np.diag(products)
    return np.maximum(own[:, None] + own - 2 * products, 0)


def fit(
    nodes: DataFrame, length: int, n: int, threshold: float, train_vectors: int, spread: float = SPREAD
) -> tuple[Index, np.ndarray]:
    """An index learnt from about ``train_vectors`` vectors, chosen by a hash, and how far to
    probe. Lists: about the root of the number of vectors, ``MOST_LISTS`` at most."""
    sample = (
        nodes.filter(F.size("vector") == length)
        .filter(hash_share(F.col("node"), "index") * n < train_vectors)
        .orderBy("node")
        .select("vector")
        .toPandas()
    )
    if not len(sample):
        sample = nodes.filter(F.size("vector") == length).orderBy("node").limit(1).select("vector").toPandas()
    x = _unit(sample["vector"])[1]
    index = train(x, int(min(MOST_LISTS, max(1, round(n**0.5)))))
    return index, reaches(index, x, threshold, spread)


def _placed(nodes: DataFrame, index: Index, reach: np.ndarray) -> DataFrame:
    """node, weight, vector, home, probes, codes, error. Vectors of another length than the
    index's have a list of their own, -length, and no codes."""
    shared = nodes.sparkSession.sparkContext.broadcast((index, reach))

    def place(batches):
        for batch in batches:
            index, reach = shared.value
            vectors = batch.column(2).to_pylist()
            home, probes = [-len(v) for v in vectors], [[-len(v)] for v in vectors]
            codes: list = [None] * len(vectors)
            error = [0.0] * len(vectors)
            own = [i for i, v in enumerate(vectors) if len(v) == index.length]
            for start in range(0, len(own), 2048):
                part = own[start : start + 2048]
                _, x = _unit([vectors[i] for i in part])
                at, _ = _nearest(x, index.centres)
                c, e = index.encode(x, at)
                for i, h, p, code, off in zip(part, at.tolist(), index.probes(x, at, reach), c, e.tolist()):
                    home[i], probes[i], codes[i], error[i] = h, p.tolist(), code.tobytes(), off
            yield pa.RecordBatch.from_pydict(
                {
                    "node": batch.column(0),
                    "weight": batch.column(1),
                    "vector": batch.column(2),
                    "home": pa.array(home, pa.int32()),
                    "probes": pa.array(probes, pa.list_(pa.int32())),
                    "codes": pa.array(codes, pa.binary()),
                    "error": pa.array(error, pa.float64()),
                }
            )

    kind = nodes.schema["vector"].dataType.simpleString()
    return nodes.select("node", "weight", "vector").mapInArrow(
        place,
        f"node bigint, weight bigint, vector {kind}, home int, probes array<int>, codes binary, error double",
    )


def _search(index_of, threshold: float):
    """Links between the queries and the list's vectors of one group.

    Returns rows (a, null, n): n more vectors are linked with a; and rows (a, b, 0): links
    enough to connect what is linked here. A pair is counted at both ends by its first finder;
    if each end probes the other's list, each counts for itself.
    """
    reach = np.sqrt(2 - 2 * threshold)

    def found(group: pd.DataFrame) -> pd.DataFrame:
        index = index_of()
        which = int(group["list"].iloc[0])
        base, query = group[group["is_base"]], group[~group["is_base"]]
        if not len(base) or not len(query):
            return pd.DataFrame({"a": [], "b": [], "n": []}).astype({"a": "int64", "b": "Int64", "n": "int64"})
        exact_b, x_b = _unit(base["vector"])
        exact_q, x_q = _unit(query["vector"])
        norm_b, norm_q = (np.sqrt((v**2).sum(1)) for v in (exact_b, exact_q))
        id_b, id_q = base["node"].to_numpy(), query["node"].to_numpy()
        coded = which >= 0
        if coded:
            codes = np.frombuffer(b"".join(base["codes"]), np.uint8).reshape(len(base), -1)
            far = ((reach + base["error"].to_numpy() + ROUNDING) ** 2 + ROUNDING).astype(np.float32)
        pairs_q, pairs_b = [], []
        step = max(1, CELLS // len(base))
        for start in range(0, len(query), step):
            part = slice(start, start + step)
            if coded:
                i, j = np.nonzero(index.distances(x_q[part], which, codes) <= far)
            else:
                i, j = np.nonzero(np.ones((len(x_q[part]), len(base)), bool))
            for at in range(0, len(i), 200_000):
                p, q = i[at : at + 200_000] + start, j[at : at + 200_000]
                cosine = (exact_q[p] * exact_b[q]).sum(1) / (norm_q[p] * norm_b[q])
                keep = (cosine >= threshold) & (id_q[p] != id_b[q])
                pairs_q.append(p[keep])
                pairs_b.append(q[keep])
        p, q = (np.concatenate(v) if v else np.empty(0, np.int64) for v in (pairs_q, pairs_b))
        # does the base vector probe the query's list too?
        probes = base["probes"].tolist()
        back = np.sort(np.repeat(np.arange(len(base)), [len(v) for v in probes]) * (1 << 32) + np.concatenate(probes) + (1 << 31))
        wanted = q * (1 << 32) + query["home"].to_numpy(np.int64)[p] + (1 << 31)
        place = np.minimum(np.searchsorted(back, wanted), len(back) - 1)
        alone = back[place] != wanted
        n_q = np.bincount(p, base["weight"].to_numpy()[q], len(query))
        n_b = np.bincount(q[alone], query["weight"].to_numpy()[p[alone]], len(base))
        links = forest(id_q[p], id_b[q])
        counts = [(int(a), None, int(n)) for a, n in zip(id_q, n_q) if n] + [(int(a), None, int(n)) for a, n in zip(id_b, n_b) if n]
        out = pd.DataFrame([*counts, *((a, b, 0) for a, b in links)], columns=["a", "b", "n"])
        return out.astype({"a": "int64", "b": "Int64", "n": "int64"})

    return found


def vector_groups(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    threshold: float = THRESHOLD,
    spread: float = SPREAD,
    train_vectors: int = TRAIN_VECTORS,
    block: int = BLOCK,
) -> DataFrame:
    """key, n_links, component_id, kept for every row.

    ``n_links``: other rows linked directly (cosine of ``threshold`` at least), copies
    included; ``component_id``: the least key reached, the row's own included. Rows whose
    vector is null, empty or all zero, or has null or non-finite components, link with
    nothing. Vectors of different lengths don't link. Null keys are never the least.

    Every vector is indexed and every one is a query. Copies are indexed once, with their
    number. A list is cut into blocks of about ``block`` vectors and queries, so a task never
    holds a list. ``spread``: a vector at the threshold, off its partner in a direction as
    the sample has them, lies that many standard deviations inside the lists probed.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).alias("key"), F.col(vector).alias("vector")).withColumn("usable", usable("vector"))
    nodes = settle(
        rows.filter("usable")
        .groupBy("vector")
        .agg(F.count(F.lit(1)).alias("weight"), F.min("key").alias("least"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    lengths = nodes.groupBy(F.size("vector").alias("length")).count().orderBy(F.desc("count"), "length").first()
    alone = rows.filter("not usable").select(
        "key", F.lit(0).cast("bigint").alias("n_links"), F.col("key").alias("component_id")
    )
    if lengths is None:
        return _finished(alone, key)
    length, n = lengths
    index, reach = fit(nodes, length, n, threshold, train_vectors, spread)
    placed = settle(_placed(nodes, index, reach))

    def blocks(lists: DataFrame, name: str) -> DataFrame:
        """How many blocks a list has; as many rows as lists."""
        return lists.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(name))

    bases = placed.select("*", F.col("home").alias("list"))
    queries = placed.select("node", "weight", "vector", "home", F.explode("probes").alias("list"))
    sizes = blocks(placed.select(F.col("home").alias("list")), "n_base").join(
        blocks(placed.select(F.explode("probes").alias("list")), "n_query"), "list"
    )
    sizes = F.broadcast(settle(sizes))
    spot = F.xxhash64("node")
    base_rows = (
        bases.join(sizes, "list")
        .withColumn("base_block", F.pmod(spot, "n_base"))
        .withColumn("query_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_query") - F.lit(1).cast("bigint"))))
        .withColumn("is_base", F.lit(True))
    )
    query_rows = (
        queries.join(sizes, "list")
        .withColumn("query_block", F.pmod(spot, "n_query"))
        .withColumn("base_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_base") - F.lit(1).cast("bigint"))))
        .withColumn("is_base", F.lit(False))
        .withColumn("probes", F.lit(None).cast("array<int>"))
        .withColumn("codes", F.lit(None).cast("binary"))
        .withColumn("error", F.lit(0.0))
    )
    columns = ["list", "base_block", "query_block", "is_base", "node", "weight", "vector", "home", "probes", "codes", "error"]
    shared = spark.sparkContext.broadcast(index)
    found = settle(
        base_rows.select(*columns)
        .unionByName(query_rows.select(*columns))
        .groupBy("list", "base_block", "query_block")
        .applyInPandas(_search(lambda: shared.value, threshold), "a bigint, b bigint, n bigint")
    )
    tied = components(found.filter("b is not null").select("a", "b"))
    counts = found.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("linked"))
    label = (
        nodes.select("node", "least").join(tied, "node").groupBy("component").agg(F.min("least").alias("component_id"))
    )
    by_vector = (
        nodes.join(counts, "node", "left")
        .join(tied.join(label, "component").select("node", "component_id"), "node", "left")
        .select(
            "vector",
            (F.col("weight") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"),
            F.coalesce("component_id", "least").alias("component_id"),
        )
    )
    linked = rows.filter("usable").join(by_vector, "vector").select("key", "n_links", "component_id")
    return _finished(linked.unionByName(alone), key)


def _finished(rows: DataFrame, key: str) -> DataFrame:
    kept = F.coalesce(F.col("key") == F.col("component_id"), F.lit(False))
    return rows.withColumn("kept", kept).withColumnRenamed("key", key)

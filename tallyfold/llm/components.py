"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.sources.shared import settle

MOST_ROUNDS = 60


def _large_star(links: DataFrame) -> DataFrame:
    """Each node ties its larger neighbours to the smallest node it knows."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return (
        both.filter("b > a")
        .join(least, "a")
        .select(F.col("b").alias("a"), F.col("m").alias("b"))
        .distinct()
    )


def _small_star(links: DataFrame) -> DataFrame:
    """Each node ties its smaller neighbours and itself to the smallest of them. In: a > b."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    tied = links.join(least, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for the nodes of links (a, b); component: the smallest node reached.

    The number of rounds grows with the logarithm of the longest way. Neighbours are never
    gathered: a node with many links is met by a partial minimum, a join whose partitions can
    be split, and partial distincts. Each round is written to the shared folder.
    """
    now = settle(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct()
    )
    sign = F.xxhash64("a", "b")
    before = None
    for _ in range(MOST_ROUNDS):
        seen = now.agg(F.count(F.lit(1)), F.bit_xor(sign), F.sum(sign % 1_000_003)).first()
        if seen == before:
            break
        before = seen
        now = settle(_small_star(_large_star(now)))
    else:
        raise RuntimeError(f"links not settled after {MOST_ROUNDS} rounds")
    # each link now leads from a node to the smallest of its component
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Of links between whole numbers, enough to connect what all of them connect."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for x, y in zip(np.asarray(a).tolist(), np.asarray(b).tolist()):
        p, q = root(x), root(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            kept.append((x, y))
    return kept

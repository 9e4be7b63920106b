"""Columns whose names clash with those of operators, and parity maps of shingle sets."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyfold.llm import decontamination, jaccard, language_id, mixing, token_counts
from tallyfold.llm.common import map_texts


def clashing(spark):
    rows = [(i, f"some words of text number {i % 7} that are told apart by {i % 7} only", i * 10) for i in range(30)]
    names = ("_row", "_key", "_text_key", "_kept", "_kept_text", "_own", "_mix_own", "_mix_key", "_copy", "n_hit", "N_Words")
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, own bigint")
    return docs.select("doc_id", "text", *[F.col("own").alias(n) for n in names])


def test_kept_rows_keep_all_their_columns(spark):
    docs = clashing(spark)
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert all(v == r["doc_id"] * 10 for r in kept.collect() for n, v in r.asDict().items() if n not in ("doc_id", "text"))
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(30)], "doc_id bigint, quality int, toxic int")
    mixed = mixing.mix(docs, labels)
    assert mixed.columns == docs.columns
    assert all(r["_own"] == r["_mix_own"] == r["doc_id"] * 10 for r in mixed.collect())


def test_columns_of_the_operator_replace_others(spark):
    docs = clashing(spark)
    items = spark.createDataFrame([("a", "some words of text number 3 that are told apart by 3 only")], "item_id string, text string")
    found = decontamination.decontaminate(docs, items)
    assert [c.lower() for c in found.columns].count("n_hit") == [c.lower() for c in found.columns].count("n_words") == 1
    assert {r["doc_id"] for r in found.filter("n_hit > 0").collect()} == {i for i in range(30) if i % 7 == 3}
    upper = map_texts(docs.select("doc_id", "text", F.lit(5).alias("N")), "text", "n bigint", lambda texts: {"n": pa.array([len(t) for t in texts], pa.int64())})
    assert upper.columns == ["doc_id", "n"] and upper.filter("n < 40").count() == 0


@pytest.mark.parametrize("percent", [20, 50, 85, 99])
def test_parity_maps_lose_no_link(percent):
    dice = random.Random(percent)
    for _ in range(60):
        size = dice.choice([1, 2, 3, 30, 31, 64, 65, 500])
        base = [dice.getrandbits(64) for _ in range(size)]
        sets = []
        for _ in range(12):
            own = {h for h in base if dice.random() < dice.choice([0.85, 0.95, 1.0])}
            own |= {dice.getrandbits(64) for _ in range(dice.randint(0, 1 + size // 8))}
            sets.append(np.array(sorted(own), np.uint64))
        maps = jaccard.Maps(list(range(12)), [len(s) for s in sets], [jaccard.parity_map(s) for s in sets])
        for i, s in enumerate(sets):
            linked = {
                j for j, o in enumerate(sets)
                if j != i and 100 * len(np.intersect1d(s, o)) >= percent * len(np.union1d(s, o)) and len(s) and len(o)
            }
            maps.open[:] = False
            assert maps.any_partner(i, len(s), jaccard.parity_map(s), percent) >= bool(linked)
            assert linked <= set(np.flatnonzero(maps.open).tolist())


def test_parity_maps_rule_out_most_others():
    dice = np.random.default_rng(4)
    base = dice.integers(0, 1 << 63, 1250).astype(np.uint64)
    sets = []
    for _ in range(100):
        own = np.where(dice.random(1250) < 0.13, dice.integers(0, 1 << 63, 1250).astype(np.uint64), base)
        sets.append(np.unique(own))
    parities = [jaccard.parity_map(s) for s in sets]
    assert all(len(p) * 64 <= 4 * 1250 for p in parities)
    maps = jaccard.Maps(list(range(100)), [len(s) for s in sets], parities)
    assert not any(maps.any_partner(i, len(s), p, 85) for i, (s, p) in enumerate(zip(sets, parities)))

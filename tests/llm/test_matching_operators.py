"""Near duplicates, decontamination, embeddings and components against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.core.broadcast import Broadcast
from pyspark.sql import functions as F

import corpus_pipeline
from tallyfold.llm import decontamination, embedding_dedup, jaccard
from tallyfold.llm.components import components, forest

DOCS = "doc_id bigint, text string, node string, digest string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], DOCS).repartition(5)


def reach(n, links):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        p, q = root(a), root(b)
        parent[max(p, q)] = min(p, q)
    return [root(i) for i in range(n)]


# --- components --------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    dice = random.Random(seed)
    links = [(dice.randrange(200), dice.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 400)]
    links += [(500, i) for i in range(501, 600)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    roots = reach(700, links)
    assert got == {i: roots[i] for i in {x for a, b in links if a != b for x in (a, b)}}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_forest_connects_the_same():
    dice = random.Random(1)
    links = [(dice.randrange(50), dice.randrange(50)) for _ in range(200)]
    kept = forest(np.array([a for a, _ in links]), np.array([b for _, b in links]))
    assert len(kept) < 50 and reach(50, kept) == reach(50, links)


# --- near duplicates ---------------------------------------------------------------------


def set_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3))} if words else set()


def components_by_hand(rows):
    sets = [set_of(t) for _, t in rows]
    links = [
        (i, j)
        for i in range(len(rows))
        for j in range(i)
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])
    ]
    roots = reach(len(rows), links)
    least = {}
    for (i, _), r in zip(rows, roots):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    return sorted((str(i), len(s), str(least.get(r))) for (i, _), s, r in zip(rows, sets, roots))


def copies(seed, n_groups=6, most=40):
    """Groups of texts of which single words were changed, so that similarities lie around
    the threshold; with common passages, copies and short texts."""
    dice = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    passage = dice.choices(words, k=12)
    rows = []
    for _ in range(n_groups):
        base = dice.choices(words, k=dice.choice([5, 30, 120]))
        for _ in range(dice.randint(2, most)):
            text = list(base)
            for _ in range(dice.choice([0, 1, 1, 2])):
                text[dice.randrange(len(text))] = dice.choice(words)
            rows.append(" ".join(text).replace("w1", "W1") if dice.random() < 0.3 else "\n".join(text))
    rows += [" ".join(dice.choices(words, k=40) + passage) for _ in range(60)]
    rows += ["one two", "One  two\t", "one two three four", "one two three four five", "one", "two", "", None, " \n"]
    return list(enumerate(rows))


@pytest.mark.parametrize(
    ("seed", "short", "block"), [(0, 16, 96_000), (1, 2, 500), (2, 1000, 96_000), (3, 1, 3000)]
)
def test_jaccard_components(spark, seed, short, block):
    rows = copies(seed)
    found = jaccard.near_duplicates(docs_of(spark, rows), short_list=short, block_shingles=block, sketch_bits=10)
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in found.collect())
    assert got == components_by_hand(rows)


def test_jaccard_on_null_and_repeated_ids(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (3, "x y z q"), (3, "x y z q"), (3, "other words in here"), (9, "X y z q"), (None, None), (8, "a " * 50_000)]
    found = jaccard.near_duplicates(docs_of(spark, rows))
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in found.collect())
    assert got == components_by_hand(rows)
    assert jaccard.jaccard_report(docs_of(spark, [])).collect() == []


def test_one_of_each_group_is_kept(spark):
    rows = copies(5) + [(0, copies(5)[0][1]), (None, "null id text one"), (None, "null id text two")]
    docs = docs_of(spark, rows)
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    want = {i for i, _, c in components_by_hand(rows) if i == c}
    got = [str(r["doc_id"]) for r in kept.collect()]
    assert set(got) == want and got.count("0") == 1 and got.count("None") == 2


def test_stage_links_on_five_words_from_80_percent(spark):
    dice = random.Random(9)
    words = dice.sample([f"w{i}" for i in range(5000)], 1000)
    base = words[:104]
    # 100 shared of 124, of 125 and of 126 runs of five words
    rows = [(1, " ".join(base))] + [(i, " ".join(base + words[i * 100 : i * 100 + n])) for i, n in ((2, 24),)]
    rows += [(3, " ".join(words[400:504])), (4, " ".join(words[400:504] + words[600:625]))]
    rows += [(5, " ".join(words[700:804])), (6, " ".join(words[700:804] + words[850:876]))]
    docs = docs_of(spark, rows)
    kept = corpus_pipeline.distinct_documents(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 5, 6]
    assert jaccard.keep_one(docs).count() == 6


def test_search_is_exact():
    dice = random.Random(8)
    base = dice.sample(range(10**6), 100)
    sets = []
    for _ in range(120):
        own = set(base)
        for _ in range(dice.randint(0, 20)):
            own.discard(dice.choice(base))
            own.add(dice.randrange(10**6))
        sets.append(np.array(sorted(own), np.uint64))
    sets += [np.array([1], np.uint64), np.array([1, 2], np.uint64), np.empty(0, np.uint64)]
    lists = jaccard.Lists(sets)
    for q in sets:
        want = [i for i, s in enumerate(sets) if len(q) and 100 * len(np.intersect1d(q, s)) >= 85 * len(np.union1d(q, s))]
        for common in (1, 4, 30):
            assert sorted(lists.search(q, 85, common)) == want


# --- decontamination ---------------------------------------------------------------------


def words_by_hand(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def hits_by_hand(docs, items):
    out = []
    for i, t in docs:
        words = words_by_hand(t)
        hit, found = set(), set()
        for item, text in items:
            if item is None:
                continue
            own = words_by_hand(text)
            for k in range(max(1, len(own) - 9)) if own else ():
                w = own[k : k + 10]
                for p in range(len(words) - len(w) + 1):
                    if words[p : p + len(w)] == w:
                        hit.update(range(p, p + len(w)))
                        found.add(str(item))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((str(i), len(words), len(hit), len(found), digest, bool(hit)))
    return sorted(out)


@pytest.mark.parametrize("block_windows", [500_000, 7])
def test_decontamination(spark, block_windows):
    dice = random.Random(6)
    words = ["a", "b", "c", "é", "7", "Zed", "word"]
    items = [(i, " ".join(dice.choices(words, k=dice.choice([1, 2, 5, 10, 14, 30])))) for i in range(12)]
    items += [(12, items[3][1]), (100, "x-y_z"), (101, ""), (102, None), (None, "a"), (103, "alone here"), (3, "again " * 12)]
    docs = [(i, " ".join(dice.choices(words, k=40))) for i in range(10)]
    docs += [(20 + i, f"q {t}. q {t!s}") for i, (_, t) in enumerate(items) if t]
    docs += [(50, None), (51, ""), (52, "--"), (53, "X,Y z"), (None, "again " * 30), (54, "clean"), (54, "clean"), (55, "Alone-HERE")]
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumn("n_hit", F.lit(1))
    found = decontamination.decontaminate(docs_of(spark, docs).select("doc_id", "text"), bench, block_windows=block_windows)
    got = sorted((str(r[0]), *r[1:]) for r in found.collect())
    assert got == hits_by_hand(docs, items)
    clean = decontamination.keep_clean(docs_of(spark, docs), bench)
    assert clean.columns == docs_of(spark, []).columns
    assert sorted(str(r["doc_id"]) for r in clean.collect()) == sorted(r[0] for r in hits_by_hand(docs, items) if not r[-1])
    assert decontamination.decontaminate(docs_of(spark, docs).select("doc_id", "text"), bench.limit(0)).filter("contaminated").count() == 0
    assert decontamination.decontaminate(docs_of(spark, []).select("doc_id", "text"), bench).count() == 0


def test_decontamination_with_repeated_benchmark_rows(spark):
    long = " ".join(f"v{i}" for i in range(14))
    items = [(1, long), (1, long), (2, "one two three"), (2, "One  two-three"), (3, long), (3, long + " end"), (4, "alone")]
    items += [(5, "p q"), (5, "p q"), (5, None), (6, "never met here"), (6, "never met here")]
    docs = [(1, f"x {long} y"), (2, "say one two three now"), (3, "alone"), (4, f"{long} end"), (5, "o p q"), (6, "clean")]
    bench = spark.createDataFrame(items, "item_id bigint, text string").repartition(3)
    found = decontamination.decontaminate(docs_of(spark, docs).select("doc_id", "text"), bench)
    got = sorted((str(r[0]), *r[1:]) for r in found.collect())
    assert got == hits_by_hand(docs, items)
    clean = decontamination.keep_clean(docs_of(spark, docs), bench)
    assert [r["doc_id"] for r in clean.collect()] == [6]


def test_blocks_of_windows_are_held_one_at_a_time(spark, monkeypatch):
    dice = random.Random(4)
    words = [f"v{i}" for i in range(60)]
    items = [(i, " ".join(dice.choices(words, k=13))) for i in range(8)] + [(8, "v1 v2"), (9, "v1 v2")]
    docs = [(i, f"x {t} {items[i - 1][1]} y") for i, t in items] + [(i % 3, items[0][1]) for i in range(30)]
    held, most = set(), []
    give, drop = type(spark.sparkContext).broadcast, Broadcast.destroy

    def broadcast(context, value):
        made = give(context, value)
        if isinstance(value, decontamination.Windows):
            held.add(id(made))
            most.append(len(held))
        return made

    def destroy(made, *args, **named):
        held.discard(id(made))
        return drop(made, *args, **named)

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", broadcast)
    monkeypatch.setattr(Broadcast, "destroy", destroy)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = decontamination.decontaminate(docs_of(spark, docs).select("doc_id", "text"), bench, block_windows=12)
    got = sorted((str(r[0]), *r[1:]) for r in found.collect())
    assert got == hits_by_hand(docs, items)
    assert len(most) > 1 and max(most) == 1


def test_decontamination_on_longer_shingles(spark):
    items = [(1, " ".join(f"v{i}" for i in range(14))), (2, "four words are here"), (3, "a b c d e")]
    docs = [(1, "x " + items[0][1]), (2, "four words are here"), (3, "a b c d e f"), (4, "a b c d")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = decontamination.decontaminate(docs_of(spark, docs).select("doc_id", "text"), bench, shingle=5)
    got = sorted((str(r[0]), *r[1:]) for r in found.collect())
    assert got == hits_by_hand(docs, items)


def test_words_of_many_texts_are_hashed_at_once():
    dice = random.Random(8)
    words = ["a", "b", "É", "7", "Zed", "w" * 1100, "w" * 1200, *[f"v{i}" for i in range(4000)]]
    texts = [None, "", " -- ", "A", " ".join(dice.choices(words, k=20_000)), "a", None, " ".join(words), ""]
    made = decontamination.Texts(texts)
    by_word, own = {}, [words_by_hand(t) for t in texts]
    assert made.counts().tolist() == [len(w) for w in own]
    for i, listed in enumerate(own):
        assert [w.decode() for w in made.words(i)] == listed
        for w, h in zip(listed, made.hashes[made.first[i] : made.first[i + 1]].tolist(), strict=True):
            assert by_word.setdefault(w[:1000], h) == h
    assert len(set(by_word.values())) == len(by_word)
    # a run of words ends with its text
    runs = decontamination.Texts(["x y", "y x y", "x", "y"])
    key = decontamination.ngram_hashes(runs.hashes[:2], 2).view(np.int64)
    assert [c.tolist() for c in decontamination.Keys(key).met(runs, 2)] == [[0, 1], [0, 3], [0, 0]]
    assert not len(decontamination.Keys(key[:0]).met(runs, 2)[0])


# --- embeddings --------------------------------------------------------------------------


def vectors(seed, n=600, size=64):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, size))
    for group in range(12):
        at = r.choice(n, 2 + 3 * group, replace=False)
        x[at] = r.normal(size=size) + r.choice([0.05, 0.2, 0.3], len(at))[:, None] * r.normal(size=(len(at), size))
    x[5], x[6], x[7] = x[4], 3 * x[4], -x[4]
    rows = [(i, [float(np.float32(v)) for v in row]) for i, row in enumerate(x)]
    odd = [None, [], [0.0] * size, [1.0, None] + [0.0] * (size - 2), [float("nan")] * size, [float("inf")] * size]
    rows += [(1000 + i, v) for i, v in enumerate(odd)]
    rows += [(2000, [1.0, 0.0]), (2001, [1.0, 0.1]), (2002, [0.0, 1.0]), (2001, [1.0, 0.1]), (None, [1.0, 0.0])]
    return rows


def groups_by_hand(rows):
    links, n = [], [0] * len(rows)
    usable = [v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(v) for _, v in rows]
    unit = [np.array(v) / np.linalg.norm(v) if u else None for (_, v), u in zip(rows, usable)]
    for i in range(len(rows)):
        for j in range(i):
            if usable[i] and usable[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.95:
                links.append((i, j))
                n[i] += 1
                n[j] += 1
    roots = reach(len(rows), links)
    least = {}
    for (i, _), root in zip(rows, roots):
        if i is not None:
            least[root] = min(i, least.get(root, i))
    return sorted((str(i), k, str(least.get(r)), i is not None and i == least.get(r)) for (i, _), k, r in zip(rows, n, roots))


@pytest.mark.parametrize(("seed", "block"), [(0, 4096), (1, 16)])
def test_embedding_groups(spark, seed, block):
    rows = vectors(seed)
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("weight", F.lit("x")).repartition(4)
    # wide probes: every list, so the result is whole
    found = embedding_dedup.vector_groups(df, spread=100.0, block=block).collect()
    got = sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in found)
    assert got == groups_by_hand(rows)


def test_embedding_recall_at_the_default_probes(spark):
    rows = [r for r in vectors(3, n=1500) if r[0] is not None and r[0] < 1000]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    found = {r["vec_id"]: r["n_links"] for r in embedding_dedup.vector_groups(df).collect()}
    want = {int(i): n for i, n, _, _ in groups_by_hand(rows)}
    assert all(found[i] <= n for i, n in want.items())
    assert sum(found.values()) >= 0.98 * sum(want.values())


def test_embedding_recall_on_few_effective_dimensions(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(400, 6))
    x = np.vstack([x, x + 0.22 * r.normal(size=x.shape)]) @ np.linalg.qr(r.normal(size=(1024, 6)))[0].T
    rows = [(i, row.tolist()) for i, row in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = {r["vec_id"]: r["n_links"] for r in embedding_dedup.vector_groups(df).collect()}
    want = {int(i): n for i, n, _, _ in groups_by_hand(rows)}
    assert all(found[i] <= n for i, n in want.items())
    assert sum(found.values()) >= 0.98 * sum(want.values())


def test_no_usable_embedding(spark):
    kind = "vec_id bigint, embedding array<float>"
    assert embedding_dedup.vector_groups(spark.createDataFrame([], kind)).collect() == []
    got = embedding_dedup.vector_groups(spark.createDataFrame([(1, None), (2, [0.0])], kind)).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 1, True), (2, 0, 2, True)]

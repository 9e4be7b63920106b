"""Merkle manifest, hard negatives and fingerprints against SQL and brute force."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from tallyfold.llm import fingerprints, hard_negatives, merkle
from tallyfold.llm.common import table
from tallyfold.llm.expected import SQL
from tallyfold.llm.queries import QUERIES
from tests.compare import compare, duck

SMOKE_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_against_sql(spark, name):
    assert compare(QUERIES[name](spark, SMOKE_DIR), duck(SMOKE_DIR), SQL[name]) is None


# --- merkle manifest ---------------------------------------------------------------------

DOCS = "doc_id bigint, source string, lang string, n_chars bigint, text string, run string, node int, seq int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def runs(level):
    return [level[i : i + 16] for i in range(0, len(level), 16)]


def manifest_by_hand(rows):
    def leaf(values):
        return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])

    def lowered(t):
        return None if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)

    def tree(level):
        levels = [level]
        while len(level) > 1:
            level = [h(*r) for r in runs(level)]
            levels.append(level)
        return levels

    def climb(levels, pos, mine, proof):
        for level in levels[:-1]:
            run, place = level[pos // 16 * 16 : pos // 16 * 16 + 16], pos % 16
            proof += run[:place] + run[place + 1 :]
            mine = h(*run[:place], mine, *run[place + 1 :])
            pos //= 16
        return mine

    groups = {}
    for r in rows:
        found = leaf((*r[:4], lowered(r[4]))) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else leaf(r[:5])
        groups.setdefault(r[1], []).append((r[0] is not None, r[0], leaf(r[:5]), found))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda x: (x[0], x[1] or 0, x[2]))
        trees[g] = tree([x[2] for x in groups[g]])
    top = tree([trees[g][-1][0] for g in order])
    out = []
    for place, g in enumerate(order):
        for pos, (_, key, mine, found) in enumerate(groups[g]):
            proof = []
            folded = climb(top, place, climb(trees[g], pos, found, proof), proof)
            root = top[-1][0]
            out.append((str(key), mine, trees[g][-1][0], root, h(*proof), folded, folded == root))
    return sorted(out)


def manifest_of(spark, rows):
    made = spark.createDataFrame([(*r, "r", 1, 2) for r in rows], DOCS).repartition(4)
    return sorted((str(r["doc_id"]), *tuple(r)[1:]) for r in merkle.manifest(made).collect())


def records(seed, n_groups, most):
    dice = random.Random(seed)
    names = [None, "", "-", "web", "wéb", "Z", *[f"s{i}" for i in range(n_groups)]]
    return [
        (
            dice.choice([i, i, -i, i * 10**12]), dice.choice(names), dice.choice([None, "en", ""]), dice.choice([None, i]),
            dice.choice([None, "", "plain", "Ünïcode ÄÖ", "ABC" * dice.randrange(99)]),
        )
        for i in range(most)
    ]


@pytest.mark.parametrize(("seed", "n_groups", "most"), [(0, 1, 700), (1, 300, 900)])
def test_manifest_by_hand(spark, seed, n_groups, most):
    rows = records(seed, n_groups, most)
    rows += rows[:40] + [(None, "web", "en", 3, "AB")] * 35 + [(None, None, None, None, None)] * 3
    # one group, and one repeated row, with a third of all rows
    rows += [(10**6 + i, "hot", "en", i, "Hot Text") for i in range(400)] + [(7, "hot", "en", 7, "Same Row")] * 300
    assert manifest_of(spark, rows) == manifest_by_hand(rows)


def test_small_manifests(spark):
    assert manifest_of(spark, []) == []
    for rows in (
        [(1, "a", "en", 1, "A" * 300_000)],
        [(1, "a", "en", 1, "x"), (2, "b", "en", 1, "X")],
        [(i, None, None, None, None) for i in range(17)],
    ):
        assert manifest_of(spark, rows) == manifest_by_hand(rows)
    lone = manifest_of(spark, [(1, "a", "en", 1, "x")])[0]
    assert lone[1] == lone[2] == lone[3] and lone[4] == h("")


def test_a_change_anywhere_is_seen(spark):
    rows = records(3, 5, 60)
    before = {r[3] for r in manifest_of(spark, rows)}
    changed = [*rows[:20], (*rows[20][:4], "other"), *rows[21:]]
    assert before != {r[3] for r in manifest_of(spark, changed)}
    assert before == {r[3] for r in manifest_of(spark, rows[::-1])}


def test_row_limit_is_given_back(spark):
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    manifest_of(spark, records(4, 2, 40))
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == before


# --- hard negatives ----------------------------------------------------------------------

VECTORS = "vec_id bigint, embedding array<double>, label int, id int, row string, x int"


def negatives_by_hand(rows, every=50, positives=5, negatives=3):
    def fine(r):
        return r[0] is not None and r[2] is not None and r[1] is not None and all(
            v is not None and math.isfinite(v) for v in r[1]
        )

    kept = [(r[0], [math.floor(256 * v) for v in r[1]], r[2], n) for n, r in enumerate(rows) if fine(r)]
    out = []
    for a in kept:
        if a[0] % every:
            continue
        scored = [(-sum(p * q for p, q in zip(a[1], b[1])), b[0], b[2]) for b in kept if b[3] != a[3]]
        scored.sort()
        for ps, pid, _ in [s for s in scored if s[2] == a[2]][:positives]:
            hard = [s for s in scored if s[2] != a[2] and -50 * ps <= -100 * s[0] <= -95 * ps]
            out += [(a[0], pid, rank + 1, nid, -ps, -ns) for rank, (ns, nid, _) in enumerate(hard[:negatives])]
    return sorted(out)


def mined(spark, rows, **how):
    made = spark.createDataFrame([(*r, 1, "r", 2) for r in rows], VECTORS).repartition(5)
    return sorted(tuple(r) for r in hard_negatives.mine(made, **how).collect())


def cloud(seed, n, d, coarse=False):
    dice = np.random.default_rng(seed)
    centres = dice.normal(size=(4, d))
    rows = []
    for i in range(n):
        label = int(dice.integers(4))
        x = centres[label] + dice.normal(size=d) * 1.2
        x = np.round(x) / 256 if coarse else x / np.linalg.norm(x)
        rows.append((i, x.tolist(), label))
    return rows


@pytest.mark.parametrize(
    ("seed", "d", "coarse", "rows_at_once", "anchors_at_once"),
    [(0, 8, False, 8192, 16384), (1, 3, True, 40, 3), (2, 2, True, 7, 1)],
)
def test_negatives_by_hand(spark, seed, d, coarse, rows_at_once, anchors_at_once):
    rows = cloud(seed, 400, d, coarse)
    found = mined(spark, rows, every=20, rows_at_once=rows_at_once, anchors_at_once=anchors_at_once)
    assert found == negatives_by_hand(rows, every=20) and found


def test_negatives_of_odd_rows(spark):
    rows = cloud(5, 200, 4)
    nan, inf = float("nan"), float("inf")
    rows += [
        (None, [1.0, 0.0, 0.0, 0.0], 1), (50, None, 1), (100, [1.0, None, 0.0, 0.0], 1), (150, [nan, 0.0, 0.0, 0.0], 1),
        (0, [inf, 0.0, 0.0, 0.0], 2), (200, [1.0, 0.5, 0.1, 0.0], None), (250, [], 1), (300, [0.0] * 4, 2),
        (350, [0.5, 0.5], 3), (-50, [0.5, 0.5, 0.5, 0.5], 3), (-3, [0.0] * 4, 1), (-4, [0.0] * 4, 0),
    ]
    # repeated ids, some with the same vector and another label
    rows += rows[:3] + [(0, rows[0][1], 3), (1000, rows[7][1], rows[7][2])] * 3
    assert mined(spark, rows) == negatives_by_hand(rows)
    assert mined(spark, []) == [] and mined(spark, [(1, [1.0], 1)]) == [] and mined(spark, [(50, [1.0], 1)]) == []


def test_scores_are_exact_or_an_error(spark):
    big = float(1 << 28)
    a = np.array([[big, 1.0, big]])
    assert hard_negatives.exact_products(a, a).tolist() == [[2 * (1 << 56) + 1]]
    with pytest.raises(OverflowError):
        hard_negatives.exact_products(np.array([[1e12]]), np.array([[1e12]]))


def test_emit_holds_no_anchor():
    """The iterator may not read ahead: what it has emitted depends on what it has read."""
    read = []

    def stream():
        import struct

        for score, kind, i in [(100, 0, 1), (90, 1, 2), (80, 0, 3), (70, 1, 4), (60, 1, 5), (50, 1, 6), (40, 1, 7)]:
            read.append(i)
            yield struct.pack(hard_negatives.PACKED, 9, (1 << 63) - 1 - score, kind, i + (1 << 63), 0), 50

    found = hard_negatives.emit(stream(), 3)
    assert next(found) == (50, 1, 1, 2, 100, 90) and read == [1, 2]
    assert list(found) == [
        (50, 1, 2, 4, 100, 70), (50, 3, 1, 4, 80, 70), (50, 1, 3, 5, 100, 60), (50, 3, 2, 5, 80, 60),
        (50, 3, 3, 6, 80, 50),
    ]


# --- fingerprints ------------------------------------------------------------------------


def level_by_hand(window):
    mass = sum(round(c * math.log2(c) * 2**20) for c in Counter(window).values())
    return (32 * 5 * 2**20 - mass) >> 19


def rank_by_hand(texts):
    n = Counter(level_by_hand(t[i : i + 32]) for t in texts for i in range(len(t) - 31))
    order = sorted(range(321), key=lambda v: (v < 80, n[v], -v))
    return {v: i for i, v in enumerate(order)}, [n[v] for v in range(321)]


def fingerprint_by_hand(text, rank):
    if not text:
        return "0:"
    if len(text) < 32:
        features = [text.ljust(31, b"\0") + bytes([len(text)])]
    else:
        windows = [(rank[level_by_hand(text[i : i + 32])], i) for i in range(len(text) - 31)]
        points = Counter(min(windows[j : j + 32])[1] for j in range(len(windows) - 31))
        chosen = sorted({i for i, n in points.items() if n >= 8} | {min(windows)[1]})
        features = list(dict.fromkeys(text[i : i + 32] for i in chosen))
    filters = []
    mask = (1 << 64) - 1
    for k, feature in enumerate(features):
        if k % 160 == 0:
            filters.append([0] * 2048)
        x = 0x9E3779B97F4A7C15
        for w in range(0, 32, 8):
            x ^= int.from_bytes(feature[w : w + 8], "little")
            x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & mask
            x = (x ^ (x >> 27)) * 0x94D049BB133111EB & mask
            x ^= x >> 31
        for j in range(5):
            filters[-1][(x >> (11 * j)) & 2047] = 1
    packed = b"".join(int("".join(map(str, f)), 2).to_bytes(256, "big") for f in filters)
    return f"{len(features)}:{base64.b64encode(packed).decode()}"


def likeness_by_hand(a, b):
    def filters(f):
        raw = base64.b64decode(f.split(":")[1])
        return [{i for i in range(2048) if raw[o + i // 8] >> (7 - i % 8) & 1} for o in range(0, len(raw), 256)]

    def one_way(x, y):
        total = 0
        for f in x:
            chances = [(len(f) * len(g) / 2048, g) for g in y]
            total += len(f) * max(
                min(1, max(0, (len(f & g) - c) / (min(len(f), len(g)) - c))) if min(len(f), len(g)) > c else 0
                for c, g in chances
            )
        return total / sum(map(len, x))

    if a == b:
        return 1.0
    n, m = int(a.split(":")[0]), int(b.split(":")[0])
    if not n or not m:
        return 0.0
    x, y = filters(a), filters(b)
    return one_way(x, y) if n < m else one_way(y, x) if m < n else (one_way(x, y) + one_way(y, x)) / 2


def prose(seed, n):
    dice = random.Random(seed)
    words = [f"{dice.choice('bcdfglmnprst')}{dice.choice('aeiouäé')}{i}" for i in range(400)]
    rows = [(i, " ".join(dice.choices(words, k=dice.choice([0, 1, 3, 8, 20, 60, 200])))) for i in range(n)]
    return rows + [(n, "a" * 500), (n + 1, "x" * 31), (n + 2, "y" * 32), (n + 3, "z" * 33), (n + 4, "ab" * 40)]


def report_by_hand(rows):
    texts = [t or "" for _, t in rows]
    rank, _ = rank_by_hand([t.encode() for t in texts])
    out = []
    for i, (key, _) in enumerate(rows):
        t, following = texts[i], texts[(i + 1) % len(rows)]
        quarter = len(t) // 4
        changed = t[: len(t) - quarter] + following[:quarter]
        f, g, e = (fingerprint_by_hand(x.encode(), rank) for x in (t, following, changed))
        out.append(
            (key, len(t), hashlib.sha256(changed.encode()).hexdigest(), f, e, likeness_by_hand(f, e), likeness_by_hand(f, g))
        )
    return out


FINGERPRINTED = "doc_id bigint, text string, part int, head string, mark string, n_chars string"


def reported(spark, rows):
    made = spark.createDataFrame([(*r, 1, "h", "m", "n") for r in rows], FINGERPRINTED).repartition(3)
    return [tuple(r) for r in fingerprints.fingerprint_report(made).orderBy("doc_id").collect()]


def test_fingerprints_by_hand(spark, monkeypatch):
    rows = prose(0, 60)
    rows[5], rows[6] = (5, None), (6, "")
    rows[20] = (20, rows[21][1])
    found, want = reported(spark, rows), report_by_hand(rows)
    assert [f[:5] for f in found] == [w[:5] for w in want]
    assert np.allclose([f[5:] for f in found], [w[5:] for w in want])
    assert found[20][3] == found[21][3] and found[20][6] == 1.0


@pytest.mark.parametrize("chunk", [64, 100, 1 << 16])
def test_chunks_dont_matter(monkeypatch, chunk):
    texts = [t.encode() for _, t in prose(1, 60)]
    texts.append(b" ".join(texts) * 3)
    _, n = rank_by_hand(texts)
    monkeypatch.setattr(fingerprints, "CHUNK", chunk)
    counts = fingerprints.level_counts(texts)
    assert counts.tolist() == n
    rank = fingerprints.rarity(counts)
    ranks = dict(enumerate(rank.tolist()))
    assert fingerprints.make_fingerprints(texts, rank) == [fingerprint_by_hand(t, ranks) for t in texts]
    assert fingerprints.make_fingerprints([], rank) == [] and fingerprints.make_fingerprints([b""], rank) == ["0:"]


def test_order_of_odd_keys(spark):
    """Repeated and null keys, a lone document, no document."""
    rows = [(None, "null key " * 9), (3, "same row " * 20), (3, "same row " * 20), (3, "another text " * 9), (9, None)]
    found = reported(spark, rows)
    assert [f[0] for f in found] == [None, 3, 3, 3, 9]
    texts = {f[3]: f for f in found}
    assert len(texts) == 4
    same = [f for f in found if f[1] == 180]
    assert len(same) == 2 and max(f[6] for f in same) == 1.0
    lone = reported(spark, [(1, "abcdefgh")])
    assert lone[0][2] == hashlib.sha256(b"abcdefab").hexdigest() and lone[0][6] == 1.0
    assert reported(spark, []) == []


def test_likeness_follows_the_edit():
    dice = random.Random(4)
    words = [f"{dice.choice('bcdfgklmnprstvz')}{dice.choice('aeiou')}{dice.randrange(10**5):x}" for _ in range(3000)]
    texts = [" ".join(dice.choices(words, k=400)) for _ in range(40)]
    rank = fingerprints.rarity(fingerprints.level_counts([t.encode() for t in texts]))
    marks = fingerprints.make_fingerprints([t.encode() for t in texts], rank)
    half = fingerprints.make_fingerprints([(a[: len(a) // 2] + b[len(b) // 2 :]).encode() for a, b in zip(texts, texts[1:])], rank)
    near = [fingerprints.likeness(a, b) for a, b in zip(marks, half)]
    far = [fingerprints.likeness(a, b) for a, b in zip(marks, marks[1:])]
    assert 0.3 < min(near) and max(near) < 0.75 and max(far) < 0.2
    assert all(fingerprints.likeness(m, m) == 1.0 for m in marks)
    assert all(fingerprints.likeness(a, b) == fingerprints.likeness(b, a) for a, b in zip(marks, half))


def test_rarity_can_be_kept(spark):
    docs = table(spark, SMOKE_DIR, "documents")
    counts = fingerprints.fit_rarity(docs)
    few = fingerprints.fingerprint_report(docs.filter("doc_id < 20"), counts=counts).collect()
    whole = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprint_report(docs).collect()}
    assert few and all(whole[r["doc_id"]] == r["fingerprint"] for r in few)

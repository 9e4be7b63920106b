"""Sessions, prefix back-off, bootstrap and scans over ranges against plain versions."""

import datetime as dt
import hashlib
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyfold.operators import keys, resampling, sessions, skew

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string"
DAY = dt.datetime(2024, 1, 1)


def events(seed, n=400):
    """One user has more than half of the events, and many share a time."""
    dice = random.Random(seed)
    rows = []
    for i in range(n):
        user = dice.choice([1, 1, 1, 2, 3, 4, None])
        ts = dice.choice([None] + [DAY + dt.timedelta(minutes=10 * dice.randrange(900))] * 20)
        rows.append((i, ts, user, dice.choice(["a", "b", "c", "c", None])))
    return rows


def sessions_by_hand(rows, gap):
    out, number, last = [], Counter(), {}
    for i, ts, user, kind in sorted((r for r in rows if r[1] and r[2] is not None), key=lambda r: (r[2], r[1], r[0])):
        fresh = user not in last or ts - last[user][0] > gap
        number[user] += fresh
        out.append((user, i, kind or "", "^" if fresh else last[user][1], number[user]))
        last[user] = (ts, kind or "")
    return out


@pytest.mark.parametrize("parts", [1, 13])
def test_sessions(spark, parts):
    rows = events(0)
    df = spark.createDataFrame(rows, EVENTS).repartition(6)
    want = sessions_by_hand(rows, dt.timedelta(minutes=30))
    got = sessions.with_sessions(df, "user_id", "event_type", "30 minutes", parts=parts)
    found = sorted(tuple(r) for r in got.select("user_id", "event_id", "event_type", "before", "session").collect())
    assert found == sorted(want)
    pairs = Counter((before, kind) for _, _, kind, before, _ in want)
    total = Counter(before for _, _, _, before, _ in want)
    kinds = len({kind for _, _, kind, _, _ in want})
    surprise = {}
    for user, _, kind, before, number in want:
        p = (pairs[before, kind] + 1) / (total[before] + kinds)
        surprise.setdefault((user, number), []).append(-math.log(p))
    out = sessions.session_surprise(df, "user_id", "event_type", "30 minutes", parts=parts).collect()
    assert {(r["user_id"], r["session"]): (r["n_events"], pytest.approx(r["surprise"])) for r in out} == {
        k: (len(v), sum(v) / len(v)) for k, v in surprise.items()
    }


def test_no_events(spark):
    df = spark.createDataFrame([(1, None, 3, "a"), (2, DAY, None, "b")], EVENTS)
    assert sessions.session_surprise(df, "user_id", "event_type", "1 hour").collect() == []


# --- scans over ranges -------------------------------------------------------------------


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_scans(spark, parts):
    dice = random.Random(parts)
    rows = [(dice.choice("aaaab"), dice.randrange(1000), i, dice.choice([None, 1, 2, 3])) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, v int, i int, x int").repartition(5)
    summed = skew.running_sums(df, ["g"], ["v", "i"], {"n": F.lit(1), "s": F.col("x")}, parts)
    both = skew.previous_values(summed, ["g"], ["v", "i"], {"v0": "v", "x0": "x"}, parts).collect()
    got = {r["i"]: r for r in both}
    seen: dict = {}
    for g, v, i, x in sorted(rows):
        n, s, v0, x0 = seen.get(g, (0, 0, None, None))
        r = got[i]
        assert (r["n"], r["s"] or 0, r["v0"], r["x0"]) == (n + 1, s + (x or 0), v0, x0)
        seen[g] = (n + 1, s + (x or 0), v, x)


def test_no_task_of_a_scan_holds_a_group(spark):
    """A group with all rows is cut into ranges."""
    df = spark.range(4000).select(F.lit(1).alias("g"), "id")
    ranged = df.repartitionByRange(10, "g", "id").groupBy(F.spark_partition_id()).count()
    assert max(r["count"] for r in ranged.collect()) < 1200
    out = skew.running_sums(df, ["g"], ["id"], {"n": F.lit(1)}, 10)
    assert out.filter("n != id + 1").count() == 0


# --- back-off ----------------------------------------------------------------------------


def test_backoff(spark):
    dice = random.Random(2)
    rows = []
    for i in range(150):
        tokens = dice.choice([None, [], *[[dice.choice("pq") for _ in range(dice.randrange(1, 7))] for _ in range(8)]])
        rows.append((i, tokens, dice.choice([None, 0, 1, 2]), i % 4))
    df = spark.createDataFrame(rows, "id int, tokens array<string>, y int, fold int").repartition(4)
    got = {r["id"]: r for r in keys.backoff_scores(df, "tokens", "y", "fold", 3, "id", 4, depth=3).collect()}
    assert len(got) == len(rows)
    for i, tokens, y, fold in rows:
        mine, probs, level = tokens or [], [1 / 3] * 3, -1
        for k in range(min(3, len(mine)) + 1):
            seen = Counter(
                z for _, other, z, f in rows if z is not None and (y is None or f != fold) and len(other or []) >= k and (other or [])[:k] == mine[:k]
            )
            if sum(seen.values()):
                probs = [(seen[c] + 2 * probs[c]) / (sum(seen.values()) + 2) for c in range(3)]
                level = k
        assert got[i]["level"] == level and got[i]["probs"] == pytest.approx(probs)


# --- bootstrap ---------------------------------------------------------------------------


def weight(i, r):
    u = int(hashlib.md5(f"{'' if i is None else i}|{r}".encode()).hexdigest()[:13], 16)
    return sum(u >= e for e in resampling.EDGES)


def test_weights_follow_the_law(spark):
    df = spark.range(20_000).select(resampling.poisson_weight(F.col("id"), F.lit(3)).alias("w"), "id")
    rows = df.collect()
    assert all(r["w"] == weight(r["id"], 3) for r in rows[:500])
    share = Counter(r["w"] for r in rows)
    for k in range(4):
        assert share[k] / 20_000 == pytest.approx(math.exp(-1) / math.factorial(k), abs=0.015)


def test_bootstrap(spark):
    dice = random.Random(6)
    rows = [(i, dice.choice([None, 0, 1, 2]), dice.choice([None, 0, 1, 2]), dice.choice([0, 1, 2])) for i in range(120)]
    a = spark.createDataFrame([r[:3] for r in rows], "id int, y int, y_hat int").repartition(3)
    b = spark.createDataFrame([(r[0], r[3]) for r in rows[5:]] + [(999, 1)], "id int, y_hat int")
    got = resampling.bootstrap_pair(a, b, [0, 1, 2], 8)
    found = {r["replicate"]: r for r in got.collect()}
    assert set(found) == set(range(8))
    for r in range(8):
        for place, name in ((2, "macro_f1_a"), (3, "macro_f1_b")):
            f1 = []
            for c in range(3):
                used = [(x, weight(x[0], r)) for x in rows[5:] if x[1] is not None]
                tp = sum(w for x, w in used if x[1] == c == x[place])
                both = sum(w for x, w in used if x[1] == c) + sum(w for x, w in used if x[place] == c)
                f1.append(2 * tp / both if both else 0.0)
            assert found[r][name] == pytest.approx(sum(f1) / 3)
    one = resampling.interval(got).first()
    deltas = [r["delta"] for r in found.values()]
    assert one["n_replicates"] == 8 and one["mean"] == pytest.approx(sum(deltas) / 8)
    assert min(deltas) <= one["low"] <= one["high"] <= max(deltas)
    with pytest.raises(Exception, match="repeated id"):
        resampling.bootstrap_pair(a.union(a), b, [0, 1, 2], 2).collect()

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyfold.functions.versions import version_key
from tallyfold.operators import registry, submissions

DAY = dt.datetime(2024, 1, 1)


def entries(spark):
    rows = [
        ("text", "original", "oof", 0, 0.60),
        ("text", "v1.2", "oof", 1, 0.755),
        ("text", "v1.7", "oof", 2, 0.7555),
        ("text", "v1.7", "oof", 3, 0.7553),
        ("text", "v1.12", "oof", 4, 0.7543),
        ("text", "v3.7", "oof", 5, 0.70),
        ("text", "v3.7_fix", "oof", 6, 0.7083),
        ("files", "v1.5", "platform", 0, 0.923),
        ("files", "v1.6", "platform", 1, 0.904),
        ("files", "v1.6", "local", 1, 0.9247),
        ("files", "draft", "platform", 9, 0.99),
    ]
    rows = [(p, v, m, DAY + dt.timedelta(days=d), s) for p, v, m, d, s in rows]
    return spark.createDataFrame(
        rows, "project string, version string, metric string, logged_at timestamp_ntz, score double"
    )


def test_versions_sort_by_number(spark):
    names = ["v3.7_fix", "v1.12", "original", "v1.7", "v1.2", "v3.7", "v2.0"]
    df = spark.createDataFrame([(n,) for n in names], "v string")
    got = [r.v for r in df.orderBy(version_key(F.col("v"))).collect()]
    assert got == ["original", "v1.2", "v1.7", "v1.12", "v2.0", "v3.7", "v3.7_fix"]
    odd = spark.createDataFrame([("v1",), ("1.2",), ("",), ("v99999999999.1",)], "v string")
    assert all(r.k is None for r in odd.select(version_key(F.col("v")).alias("k")).collect())


def test_latest(spark):
    got = {r.project: r.version for r in registry.latest_version(entries(spark)).collect()}
    assert got == {"text": "v3.7_fix", "files": "v1.6"}


def test_delta(spark):
    rows = registry.version_delta(entries(spark)).collect()
    got = {(r.metric, r.version): r for r in rows}
    assert got["platform", "v1.6"].delta_points == pytest.approx(-1.9)
    assert got["platform", "v1.6"].regression
    assert got["oof", "original"].delta_points is None
    assert not got["oof", "original"].regression
    assert got["oof", "v1.7"].score == 0.7553  # the later entry
    assert got["oof", "v1.12"].delta_points == pytest.approx(-0.1)
    assert got["oof", "v3.7_fix"].delta_points == pytest.approx(0.83)
    assert got["oof", "v3.7_fix"].best_before == 0.7553


def test_delta_across_segments(spark):
    rows = [("p", f"v{a}.{b}", "m", DAY, float((a * 200 + b) % 17)) for a in (1, 2) for b in range(200)]
    df = spark.createDataFrame(
        rows, "project string, version string, metric string, logged_at timestamp_ntz, score double"
    )
    got = {r.version: r for r in registry.version_delta(df).collect()}
    previous, best = None, None
    for _, version, _, _, score in rows:
        r = got[version]
        want = None if previous is None else (score - previous) * 100
        assert r.delta_points == (None if want is None else pytest.approx(want))
        assert r.best_before == best
        assert r.regression == (best is not None and score < best)
        previous, best = score, score if best is None else max(best, score)


def test_gap(spark):
    row = registry.score_gap(entries(spark), "local", "platform").first()
    assert (row.project, row.version) == ("files", "v1.6")
    assert row.gap_points == pytest.approx(2.07)


def test_records(spark):
    full = ["2024-01-01", "p", "v1.0", "a/", "m.bin", "r.csv", "yes", "n"]
    rows = [(1, *full), (2, *full[:3], None, *full[4:]), (3, *full[:7], "  ")]
    df = spark.createDataFrame(
        rows, "id bigint, " + ", ".join(f"{f} string" for f in registry.RECORD_FIELDS)
    )
    got = {(r.id, r.field, r.problem) for r in registry.check_records(df, "id").collect()}
    assert got == {(2, "archive_path", "null"), (3, "note", "blank")}


def test_index_vs_log(spark):
    index = spark.createDataFrame(
        [("a", "v1.3"), ("b", "v1.0"), ("c", "v2.0")], "project string, version string"
    )
    log = spark.createDataFrame(
        [("a", "v1.4"), ("a", "v1.2"), ("b", "v1.0"), ("d", "v1.0"), (None, "v9.9"), ("c", None)],
        "project string, version string",
    )
    got = {r.project: r.status for r in registry.index_vs_log(index, log).collect()}
    assert got == {"a": "differs", "b": "same", "c": "only_index", "d": "only_log"}


def test_submission_check(spark):
    sub = spark.createDataFrame(
        [(1, 0), (2, 1), (2, 1), (3, 7), (9, 0), (4, None)], "id bigint, y_hat int"
    )
    expected = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5, 6)], "id bigint")
    row = submissions.check_submission(sub, expected, [0, 1]).first()
    assert row.asDict() == {
        "n_expected": 6, "n_submitted": 6, "missing": 2, "extra": 1, "duplicated": 1,
        "bad_class": 2, "valid": False,
    }
    good = spark.createDataFrame([(1, 0), (2, 1)], "id bigint, y_hat int")
    assert submissions.check_submission(good, good.select("id"), [0, 1]).first().valid

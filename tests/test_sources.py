import datetime as dt

import pytest

from tallyfold.operators import manifests, submissions
from tallyfold.sources import files, run_log
from tallyfold.sources import submission as tables
from tallyfold.sources.shared import settle

LINES = [
    "- 2024-05-06：gate v1.1 done, score raised to `0.9225`。",
    "[2024-05-06 08:47:15] gate v1.1 smoke completed; selected=ensemble; macro_f1=0.158175, accuracy=0.220833, later.",
    "- 2024-05-07 17:08:27 mail v1.3; selected=fusion; oof_macro_f1=0.755433",
    "| mail | v3.7_fix passed 0.70831 | macro_f1=0.70831. | mail/log |",
    "- 2024-05-08：nothing to report",
    "free text",
    "- 2024-05-09 01:02:03 mail original; f1=0.1; f1=-0.2",
    "- 2024-99-99 01:02:03 mail v1.0",
]


def test_run_log(spark, tmp_path):
    (tmp_path / "log.md").write_text("\n".join(LINES), encoding="utf-8")
    rows = run_log.parse_run_log(run_log.read_log(spark, str(tmp_path / "log.md"))).collect()
    got = {r.line: r for r in rows}
    r = [got[x] for x in LINES]
    assert r[0].ts == dt.datetime(2024, 5, 6) and r[0].version == "v1.1" and r[0].project == "gate"
    assert r[1].ts == dt.datetime(2024, 5, 6, 8, 47, 15)
    assert r[1].metrics == {"macro_f1": 0.158175, "accuracy": 0.220833}
    assert r[1].selected == "ensemble"
    assert (r[2].project, r[2].version, r[2].selected) == ("mail", "v1.3", "fusion")
    assert r[2].metrics == {"oof_macro_f1": 0.755433}
    assert (r[3].project, r[3].version, r[3].ts) == ("mail", "v3.7_fix", None)
    assert r[3].metrics == {"macro_f1": 0.70831}
    assert (r[4].project, r[4].version, r[4].metrics) == (None, None, {})
    assert (r[5].ts, r[5].project, r[5].selected) == (None, None, None)
    assert r[6].version == "original" and r[6].metrics == {"f1": -0.2}
    assert r[7].ts is None and r[7].version == "v1.0"


def test_submission_roundtrip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, 'q"uo,te'), (3, None)], "id bigint, y_hat string")
    path = str(tmp_path / "sub")
    tables.write_submission(df, path)
    assert tables.read_submission(spark, path).exceptAll(df).count() == 0
    with pytest.raises(Exception, match="(?i)exist"):
        tables.write_submission(df, path)


def test_report(spark, tmp_path):
    checks = spark.createDataFrame([(3, 1)], "n_rows bigint, missing bigint")
    scores = spark.createDataFrame([(0.5,)], "macro_f1 double")
    path = str(tmp_path / "report")
    tables.write_report(submissions.validation_report(checks, scores), path)
    got = {r.metric: r.value for r in tables.read_report(spark, path).collect()}
    assert got == {"n_rows": 3.0, "missing": 1.0, "macro_f1": 0.5}


def tree(root, names):
    for name, content in names.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)


def test_manifest_of_files(spark, tmp_path):
    tree(tmp_path / "a", {"x/one.csv": b"123", "two.bin": b"", "smoke_t.csv": b"9", "gone": b"1"})
    tree(tmp_path / "b", {"x/one.csv": b"124", "two.bin": b"", "smoke_t.csv": b"99", "new": b"1"})
    sides = []
    for name in "ab":
        root = str(tmp_path / name)
        sides.append(manifests.relative(files.manifest(spark, root), root))
    assert manifests.totals(sides[0]).first().asDict() == {"n_files": 4, "n_bytes": 5}
    diff = manifests.reconcile(*sides)
    assert {r.path: r.status for r in diff.collect()} == {
        "x/one.csv": "same", "two.bin": "same", "smoke_t.csv": "changed",
        "gone": "removed", "new": "added",
    }
    same = manifests.reconcile_totals(manifests.reconcile(sides[0], sides[0])).collect()
    assert [(r.status, r.n_files, r.bytes_a, r.bytes_b) for r in same] == [("same", 4, 5, 5)]


def test_equal_size_other_content(spark):
    schema = "path string, length bigint, sha string"
    a = spark.createDataFrame([("p", 3, "x"), ("q", 3, "y")], schema)
    b = spark.createDataFrame([("p", 3, "z"), ("q", 3, "y")], schema)
    got = {r.path: r.status for r in manifests.reconcile(a, b, sha="sha").collect()}
    assert got == {"p": "changed", "q": "same"}


def test_contents_with_empty_and_odd_names(spark, tmp_path):
    tree(tmp_path, {"a b/ü%.bin": b"12", "empty one": b"", "c.txt": b"3"})
    rows = manifests.relative(files.contents(spark, str(tmp_path)), str(tmp_path)).collect()
    assert {r.path: bytes(r.content) for r in rows} == {
        "a b/ü%.bin": b"12", "empty one": b"", "c.txt": b"3",
    }
    only = files.manifest(spark, str(tmp_path), glob="*.txt")
    assert [r.length for r in only.collect()] == [1]


def test_manifest_does_not_read_contents(spark, tmp_path):
    tree(tmp_path, {"a": b"1"})
    plan = files.manifest(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1]


def test_leftovers(spark):
    manifest = spark.createDataFrame(
        [
            ("p", "out/smoke_run.csv"), ("p", "out/model_v1.2.bin"), ("p", "out/model_v1.12.bin"),
            ("p", "src/train.py"), ("q", "out/sub_v1.0.csv"), ("r", "x/sub_v9.9.csv"),
        ],
        "project string, path string",
    )
    registry = spark.createDataFrame(
        [("p", "v1.2"), ("p", "v1.12"), ("q", "v1.0")], "project string, version string"
    )
    got = {r.path: r.reason for r in manifests.find_leftovers(manifest, registry).collect()}
    assert got == {"out/smoke_run.csv": "temporary", "out/model_v1.2.bin": "historic"}


def test_settle_keeps_rows_and_types(spark):
    df = spark.createDataFrame([(1, "a", [1.0]), (2, None, None)], "i int, s string, a array<double>")
    again = settle(df)
    assert again.dtypes == df.dtypes
    assert again.exceptAll(df).count() == 0

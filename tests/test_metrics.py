import pytest

from tallyfold.operators import metrics

# class 3 is never predicted, class 4 never true, class 9 in neither
ROWS = [
    (1, 0, 0),
    (2, 0, 1),
    (3, 1, 1),
    (4, 1, None),
    (5, 3, 0),
    (6, None, 1),
    (7, 1, 4),
]
F1 = {0: 2 * 1 / 4, 1: 2 * 1 / 5, 3: 0.0, 4: 0.0}


@pytest.fixture(scope="module")
def pred(spark):
    return spark.createDataFrame(ROWS, "id bigint, y int, y_hat int")


def test_confusion_leaves_out_unlabelled_rows(pred):
    cells = {(r.y, r.y_hat): r.n for r in metrics.confusion(pred).collect()}
    assert sum(cells.values()) == 6
    assert cells[(1, None)] == 1


def test_class_f1_closed_has_zero_rows(pred):
    rows = metrics.class_f1(metrics.confusion(pred), [0, 1, 3, 9]).collect()
    got = {r["class"]: (r.tp, r.n_true, r.n_pred, r.f1) for r in rows}
    assert got == {
        0: (1, 2, 2, 0.5),
        1: (1, 3, 2, 0.4),
        3: (0, 1, 0, 0.0),
        9: (0, 0, 0, 0.0),
    }


def test_macro_f1_scopes(pred):
    open_scope = metrics.macro_f1(pred).first()
    assert open_scope.n_classes == 4
    assert open_scope.macro_f1 == pytest.approx(sum(F1.values()) / 4)
    closed = metrics.macro_f1(pred, [0, 1, 3, 9]).first()
    assert closed.macro_f1 == pytest.approx((0.5 + 0.4) / 4)
    many = metrics.macro_f1(pred, list(range(87))).first()
    assert many.macro_f1 == pytest.approx((0.5 + 0.4) / 87)


def test_macro_f1_positive_ignores_false_alarms(pred):
    got = metrics.macro_f1_positive(pred, classes=[0, 1, 3, 4]).first()
    assert got.macro_f1 == pytest.approx((2 * 1 / 4) / 3)


def test_accuracy_and_weighted(pred):
    assert metrics.accuracy(pred).first().accuracy == pytest.approx(2 / 6)
    want = (0.5 * 2 + 0.4 * 3 + 0.0) / 6
    assert metrics.weighted_f1(pred).first().weighted_f1 == pytest.approx(want)


def test_empty_table_has_zero_score(spark):
    empty = spark.createDataFrame([], "id bigint, y int, y_hat int")
    assert metrics.macro_f1(empty, [0, 1]).first().macro_f1 == 0.0


def test_metric_by_seed(spark):
    rows = [(s, y, y if s else 0) for s in (0, 1) for y in (0, 1)]
    df = spark.createDataFrame(rows, "seed int, y int, y_hat int")
    got = metrics.metric_by_seed(df, [0, 1]).first()
    assert got.n_seeds == 2
    assert got.max_macro_f1 == 1.0
    assert got.min_macro_f1 == pytest.approx((2 / 3) / 2)


def test_class_delta_and_flips(spark):
    a = spark.createDataFrame([(1, 0), (2, 1), (3, 1), (4, 0)], "id bigint, y_hat int")
    b = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (5, 2)], "id bigint, y_hat int")
    delta = {r["class"]: r.delta for r in metrics.class_delta(a, b).collect()}
    assert delta == {0: -1, 1: 0, 2: 1}
    assert sum(delta.values()) == b.count() - a.count()
    flips = {(r.old, r.new): r.n for r in metrics.flip_matrix(a, b).collect()}
    assert flips == {(0, 1): 1, (1, 0): 1, (1, 1): 1}

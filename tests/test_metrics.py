import numpy as np
import pytest
from pyspark.sql import functions as F

from tabforge.operators import metrics


def test_confusion_union_of_labels(spark):
    df = spark.createDataFrame([(3, 3), (5, 5), (5, 7), (3, 5)], "y_true int, y_pred int")
    cm = {(r.y_true, r.y_pred): r.n for r in metrics.confusion_matrix(df).collect()}
    assert len(cm) == 9
    assert cm[(3, 3)] == 1 and cm[(5, 7)] == 1 and cm[(7, 7)] == 0 and cm[(3, 5)] == 1
    one = spark.createDataFrame([(1, 1), (1, 1)], "y_true int, y_pred int")
    assert [tuple(r) for r in metrics.confusion_matrix(one).collect()] == [(1, 1, 2)]


def test_accuracy_and_regression(spark):
    df = spark.createDataFrame([(1, 1), (0, 1), (1, 1), (0, 0)], "y_true int, y_pred int")
    r = metrics.accuracy(df).first()
    assert r.accuracy == 0.75 and r.error_rate == 0.25
    reg = spark.createDataFrame([(1.0, 1.5, False), (2.0, 2.0, False), (1.0, 1.0, True), (3.0, 2.0, True)],
                                "y_true double, y_pred double, is_test boolean")
    m = metrics.regression_metrics(reg).first()
    assert m.mse_train == pytest.approx(0.125) and m.mse_test == pytest.approx(0.5)
    assert m.r2 == pytest.approx(1 - 1.0 / 2.0) and m.grade == "low" and m.n_test == 2


def _auc_bruteforce(y, s):
    pos, neg = s[y == 1], s[y == 0]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    return wins / (len(pos) * len(neg))


def test_roc_auc_matches_rank_statistic(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 400)
    s = np.round(rng.normal(size=400) + y, 1)
    df = spark.createDataFrame([(1, int(a), float(b)) for a, b in zip(y, s)], "class int, y int, score double")
    auc = metrics.roc_auc(df, "y", "score").first().auc
    assert auc == pytest.approx(_auc_bruteforce(y, s))
    pts = metrics.roc_points(df, "y", "score").orderBy("pos").collect()
    assert (pts[0].fpr, pts[0].tpr) == (0.0, 0.0) and (pts[-1].fpr, pts[-1].tpr) == (1.0, 1.0)
    assert all(a.fpr <= b.fpr and a.tpr <= b.tpr for a, b in zip(pts, pts[1:]))
    # collinear points are dropped but the area is unchanged
    full = metrics.roc_points(df, "y", "score", drop_intermediate=False).count()
    assert len(pts) <= full


def test_inertia(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 1.0]), ([2.0, 1.0], [1.0, 1.0])], "v array<double>, c array<double>")
    assert metrics.inertia(df, "v", "c").first()[0] == pytest.approx(3.0)
    _ = F


def test_r2_with_a_large_offset_and_auc_of_one_class(spark):
    import numpy as np
    rng = np.random.default_rng(0)
    y, e = rng.normal(size=2000), rng.normal(size=2000)
    rows = [(float(1e9 + a), float(1e9 + a + b), i % 2 == 0) for i, (a, b) in enumerate(zip(y, e))]
    df = spark.createDataFrame(rows, "y_true double, y_pred double, is_test boolean")
    t = np.array([r for r in rows if r[2]])
    want = 1 - ((t[:, 0] - t[:, 1]) ** 2).sum() / ((t[:, 0] - t[:, 0].mean()) ** 2).sum()
    got = metrics.regression_metrics(df).first()
    assert abs(got.r2 - want) < 1e-6 and got.grade == "low"
    s = spark.createDataFrame([("a", 1, 0.5), ("a", 1, 0.7), ("b", 0, 0.2), ("b", 1, 0.9)], "class string, y int, score double")
    assert {r["class"]: r.auc for r in metrics.roc_auc(s, "y", "score").collect()} == {"a": None, "b": 1.0}


def test_mutual_information_keeps_missing_apart(spark):
    from tabforge.operators import select as sel
    rows = [(1.0, 1.0)] * 20 + [(10.0, 2.0)] * 20 + [(None, 3.0)] * 20 + [(float("nan"), 3.0)] * 20
    df = spark.createDataFrame(rows, "x double, y double")
    import math
    p = [20 / 80, 20 / 80, 40 / 80]
    assert abs(sel.mutual_information(df, ["x"], "y").first().mi + sum(v * math.log(v) for v in p)) < 1e-9

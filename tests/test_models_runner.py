import numpy as np
import pytest
from pyspark.sql import functions as F

from tabforge.operators import chartdata, models
from tabforge.plans import prep as P
from tabforge.plans import runner as R


@pytest.fixture(scope="module")
def iris_like(spark):
    rng = np.random.default_rng(4)
    rows = []
    for cls in range(3):
        c = np.array([1.0, 2.0, 3.0, 4.0]) + cls * 1.5
        for i in range(50):
            x = c + rng.normal(0, 0.4, size=4)
            rows.append((cls * 50 + i, *[float(v) for v in x], cls))
    return spark.createDataFrame(rows, "k long, a double, b double, c double, d double, flower_class long")


def test_prep_rules(spark):
    df = spark.createDataFrame([
        (1, "6-2", "180 lb", "2024-01-05", "Ann", "Paris,FR", "G", 100.0),
        (2, "7-0", "n/a", "13/02/2024", "Bob", "Rome,IT", "F", 200.0),
        (3, "6-5", "200", "x", "Cid", "Oslo", "G", 300.0),
        (4, "5-11", "150 kg", "3/4/2024", "Dan", "Lima,PE", "C", None),
    ], "k long, Height string, Weight string, Date string, Name string, City string, Position string, Salary double")
    res = P.preprocess(df, ["Height", "Weight", "Date", "Name", "City", "Position"], "Salary", key="k")
    kinds = {r.column: r.kind for r in res.rules}
    assert kinds == {"Height": "height", "Weight": "weight", "Date": "date", "Name": "label",
                     "City": "split_onehot", "Position": "onehot"}
    rows = {r.k: r for r in res.data.collect()}
    assert set(rows) == {1, 2}                    # row 4: NULL salary; row 3: bad date
    assert rows[1].Height == pytest.approx(187.96)
    # mean of the rows left after the first drop (row 4 has no target): (180 + 200) / 2
    assert rows[2].Weight == pytest.approx(190.0)
    assert rows[2].Date_month == 2
    assert rows[1].y == pytest.approx(np.log1p(100.0))
    assert "Position_G" in res.features and "Position_G" not in res.scaled
    assert rows[1]["City_part1_FR"] == 1


@pytest.mark.parametrize("name", ["Logistic_Regression", "Decision_Tree", "KNN", "Random_Forest_Classifier",
                                  "Bagging_Classifier", "SVM"])
def test_classifiers_beat_majority(spark, iris_like, name):
    prep = P.preprocess(iris_like, ["a", "b", "c", "d"], "flower_class", key="k", is_categorical=True)
    res = R.run_model(prep, name)
    acc = res.metrics.first().accuracy
    assert acc > 0.6, (name, acc)
    assert res.report().count() >= 1


@pytest.mark.parametrize("name", ["Linear_Regression", "Polynomial_Regression", "Random_Forest_Regressor"])
def test_regressors(spark, iris_like, name):
    df = iris_like.withColumn("target", F.col("a") * 3 + F.col("b"))
    prep = P.preprocess(df, ["a", "b"], "target", key="k")
    res = R.run_model(prep, name)
    m = res.metrics.first()
    assert m.r2 > 0.8 and m.grade == "high"


@pytest.mark.parametrize("name", ["KMeans", "DBSCAN", "Agglomerative_Clustering"])
def test_clustering(spark, iris_like, name):
    prep = P.preprocess(iris_like, ["a", "b", "c", "d"], "flower_class", key="k")
    res = R.run_model(prep, name)
    assert res.predictions.count() == 150
    assert res.metrics.first().n_clusters >= 1


def test_unknown_model(spark, iris_like):
    prep = P.preprocess(iris_like, ["a"], "flower_class", key="k")
    with pytest.raises(ValueError):
        R.run_model(prep, "nope")


def test_importances_elbow_and_persistence(spark, iris_like, tmp_dir):
    data = models.assemble(iris_like, ["a", "b", "c", "d"]).withColumn("label", F.col("flower_class").cast("double"))
    m = models.forest_classifier().fit(data)
    imp = chartdata.feature_importance(spark, m, ["a", "b", "c", "d"]).collect()
    assert sum(r.importance for r in imp) == pytest.approx(1.0)
    assert [r.importance for r in imp] == sorted([r.importance for r in imp], reverse=True)
    el = [r.inertia for r in chartdata.elbow_curve(data).orderBy("k").collect()]
    assert all(a >= b - 1e-6 for a, b in zip(el, el[1:]))
    from pyspark.ml import PipelineModel, Pipeline
    pm = Pipeline(stages=[models.decision_tree(False)]).fit(data)
    path = f"{tmp_dir}/tree-model"
    from tabforge.sources import sinks
    sinks.save_model(pm, path)
    back = PipelineModel.load(path)
    a = [r.prediction for r in pm.transform(data).orderBy("k").collect()]
    b = [r.prediction for r in back.transform(data).orderBy("k").collect()]
    assert a == b
    nodes = chartdata.tree_nodes(spark, pm.stages[0], f"{tmp_dir}/tree-nodes")
    assert nodes.count() >= 3


def test_chart_menu(spark):
    menu = chartdata.chart_menu(spark)
    assert menu.count() == 35   # 9 models x 3 charts + 4 models x 2
    assert chartdata.available_charts("KNN") == ("Scatter", "DecisionBoundary", "KValuePlot")
    with pytest.raises(ValueError):
        chartdata.dispatch("KMeans", "ROCCurve", {})


def test_boundary_predictions(spark, iris_like):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    data = iris_like.withColumn("label", F.col("flower_class").cast("double"))
    pipe = Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="features"),
                            models.decision_tree(False, max_depth=5)]).fit(data)
    r = data.agg(F.min("a"), F.max("a"), F.min("b"), F.max("b")).first()
    out = chartdata.boundary_predictions(spark, ["a", "b"], (r[0], r[1]), (r[2], r[3]), pipe.transform)
    x0, nx = chartdata.grid_axis(r[0], r[1])
    y0, ny = chartdata.grid_axis(r[2], r[3])
    assert out.count() == nx * ny
    assert set(x.prediction for x in out.select("prediction").distinct().collect()) <= {0.0, 1.0, 2.0}
    with pytest.raises(ValueError):
        chartdata.boundary_predictions(spark, ["a"], (0, 1), (0, 1), pipe.transform)


def test_chart_data_dispatch(spark, iris_like):
    from tabforge.plans.charts import chart_data
    prep = P.preprocess(iris_like, ["a", "b"], "flower_class", key="k", is_categorical=True)
    res = R.run_model(prep, "Logistic_Regression")
    roc = chart_data(res, prep, "ROCCurve")
    assert {r["class"] for r in roc.select("class").distinct().collect()} == {0, 1, 2}
    cm = chart_data(res, prep, "ConfusionMatrix")
    assert cm.count() == 9
    assert chart_data(res, prep, "Scatter").count() == 150
    tree = R.run_model(prep, "Decision_Tree")
    assert chart_data(tree, prep, "DecisionBoundary").count() > 0
    assert chart_data(tree, prep, "FeatureImportance").count() == 2
    with pytest.raises(ValueError):
        chart_data(res, prep, "Dendrogram")
    ward = R.run_model(prep, "Agglomerative_Clustering")
    assert chart_data(ward, prep, "Dendrogram").count() == 149


def test_knn_boundary_and_k_curve(spark, iris_like):
    from tabforge.plans.charts import chart_data
    prep = P.preprocess(iris_like, ["a", "b"], "flower_class", key="k", is_categorical=True)
    res = R.run_model(prep, "KNN")
    grid = chart_data(res, prep, "DecisionBoundary")
    assert grid.count() > 0 and grid.where("prediction is null").count() == 0
    curve = chart_data(res, prep, "KValuePlot").orderBy("k").collect()
    assert curve[0]["accuracy"] == 1.0      # k = 1: every row is its own neighbour


def test_svm_roc_from_decision_scores(spark, iris_like):
    from tabforge.plans.charts import chart_data
    prep = P.preprocess(iris_like, ["a", "b", "c", "d"], "flower_class", key="k", is_categorical=True)
    res = R.run_model(prep, "SVM")
    assert "y_prob" in res.predictions.columns
    roc = chart_data(res, prep, "ROCCurve")
    assert roc.select("class").distinct().count() == 3


def test_scaler_fit_on_all_or_train(spark, iris_like):
    df = iris_like.withColumn("target", F.col("a") * 3 + F.col("b"))
    prep = P.preprocess(df, ["a", "b"], "target", key="k")
    a = R.run_model(prep, "Linear_Regression", scaler_fit_on="all").metrics.first()
    t = R.run_model(prep, "Linear_Regression").metrics.first()
    # OLS is invariant to an affine rescaling of its inputs: same fit either way
    assert a.mse_test == pytest.approx(t.mse_test, rel=1e-6, abs=1e-9)
    with pytest.raises(ValueError):
        R.run_model(prep, "Linear_Regression", scaler_fit_on="test")


def test_prep_targets_dates_and_decimals(spark):
    import datetime as dt
    from decimal import Decimal

    from tabforge.plans import prep as P
    rows = [(i, dt.datetime(2024, 1 + i % 12, 3, 4), Decimal(i) / 4, "$%d,000" % (i + 1), "ab"[i % 2], f"city{i}") for i in range(24)]
    df = spark.createDataFrame(rows, "k long, when timestamp, price decimal(12,2), salary string, kind string, city string")
    res = P.preprocess(df, ["when", "price"], "salary", key="k")
    assert res.features == ["price", "when_year", "when_month", "when_day", "when_hour"] and "price" in res.scaled
    import math
    assert {r.k: round(r.y, 6) for r in res.data.collect()} == {i: round(math.log1p((i + 1) * 1000), 6) for i in range(24)}
    text = P.preprocess(df, ["price"], "kind", key="k")
    assert {r.k: r.y for r in text.data.collect()} == {i: i % 2 for i in range(24)}
    from tabforge.operators import profile
    assert profile.continuity(df, ["price"]).first()["value_range"] == 5.75


def test_fit_input_is_spread_over_partitions(spark):
    """One file of many rows is no longer one task of every pass; small tables stay as they are."""
    one = spark.range(1000).coalesce(1)
    out = models.spread(one, 100)
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(sizes) == 1000 and max(sizes) <= 100 and out.distinct().count() == 1000
    assert models.spread(one, 1000) is one and models.spread(one.limit(0), 10).count() == 0

"""Chart data for a model run (V1-V14): ``chart_data(run, prep, "ROCCurve")``
returns the table behind the chart, after checking the model offers it."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.operators import chartdata, metrics, neighbors, scale
from tabforge.plans.prep import PrepResult
from tabforge.plans.runner import RunResult


def _roc_rows(pred: DataFrame) -> DataFrame:
    """One-vs-rest rows (class, y, score) from the probability array of each test row."""
    test = pred.where("is_test")
    return (test.select("y_true", F.posexplode("y_prob").alias("class", "score"))
            .select("class", (F.col("y_true").cast("int") == F.col("class")).cast("int").alias("y"), "score"))


def chart_data(run: RunResult, prep: PrepResult, chart: str) -> DataFrame:
    pred, key, feats = run.predictions, prep.key, prep.features
    spark = pred.sparkSession

    def scatter():
        label = "cluster" if "cluster" in pred.columns else "y_pred"
        return chartdata.scatter_points(pred, feats, key, label)

    def error_plot():
        test = pred.where("is_test")
        return metrics.regression_metrics(pred) if run.continuous else metrics.accuracy(test)

    def boundary():
        r = pred.agg(F.min(feats[0]), F.max(feats[0]), F.min(feats[1]), F.max(feats[1])).first() \
            if len(feats) == 2 else None
        if r is None:
            raise ValueError("a decision boundary needs exactly 2 features")
        vec = F.array(*[F.col(f).cast("double") for f in feats])
        if run.model is not None:
            def predict(g):
                return run.model.transform(g.withColumn("features", array_to_vector(vec)))
        else:  # kNN keeps no model: vote of the k nearest training rows
            train = pred.where(~F.col("is_test")).select(F.col(key).alias("id"), vec.alias("vec"),
                                                         F.col("y_true").alias("label"))

            def predict(g):
                q = g.withColumn("id", F.col("i") * F.lit(1 << 31) + F.col("j"))
                v = neighbors.vote(neighbors.knn(train, q.select("id", vec.alias("vec")), 5))
                return q.join(v.select(F.col("q_id").alias("id"), F.col("y_pred").alias("prediction")), "id")
        return chartdata.boundary_predictions(spark, feats, (r[0], r[1]), (r[2], r[3]), predict)

    def k_curve():
        test = pred.where("is_test").select(F.col(key).alias("id"),
                                            F.array(*[F.col(f).cast("double") for f in feats]).alias("vec"),
                                            F.col("y_true").alias("label"))
        k_max = neighbors.k_max_for(test.count())
        nb = neighbors.knn(test, test.select("id", "vec"), k_max)
        return neighbors.k_value_curve(nb, test.select(F.col("id").alias("q_id"),
                                                       F.col("label").alias("y_true")), k_max)

    def elbow():
        std = scale.standard_scale(prep.data, prep.scaled)
        from tabforge.operators.models import assemble
        return chartdata.elbow_curve(assemble(std, feats))

    builders = {
        "Scatter": scatter,
        "Line": lambda: chartdata.line_series(pred.where("is_test"), key),
        "ResidualPlot": lambda: chartdata.residual_series(pred.where("is_test"), key),
        "ROCCurve": lambda: metrics.roc_points(_roc_rows(pred), "y", "score"),
        "ConfusionMatrix": lambda: metrics.confusion_matrix(pred.where("is_test")),
        "FeatureImportance": lambda: chartdata.feature_importance(spark, run.model, feats),
        "TreeDiagram": lambda: chartdata.tree_nodes(
            spark, run.model, _scratch(spark, "tree")),
        "DecisionBoundary": boundary,
        "KValuePlot": k_curve,
        "ErrorPlot": error_plot,
        "ElbowPlot": elbow,
        "Dendrogram": lambda: run.model,   # the Ward run keeps its linkage table as model
    }
    return chartdata.dispatch(run.model_type, chart, builders)


def _scratch(spark, name: str) -> str:
    import uuid
    from tabforge.session import scratch_path
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")

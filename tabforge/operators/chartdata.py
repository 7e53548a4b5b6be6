"""Chart data (V1-V14): the tables behind the reference's charts, as DataFrames.
Drawing is left to the caller; every table here can be written with a sink.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabforge.functions.scalar import residual
from tabforge.operators.models import kmeans
from tabforge.operators.ordinal import row_positions
from tabforge.session import materialize

GRID_STEP, GRID_MARGIN = 0.1, 1.0  # fixed values: decision-boundary grid

# Which charts suit which model (model key -> chart names).
CHARTS = {
    "linearregression": ("Scatter", "Line", "ResidualPlot"),
    "multipleregression": ("Scatter", "Line", "ResidualPlot"),
    "polynomialregression": ("Scatter", "Line", "ResidualPlot"),
    "logisticregression": ("Scatter", "ROCCurve", "ConfusionMatrix"),
    "decisiontree": ("TreeDiagram", "FeatureImportance", "DecisionBoundary"),
    "knn": ("Scatter", "DecisionBoundary", "KValuePlot"),
    "svm": ("Scatter", "DecisionBoundary", "ROCCurve"),
    "baggingclassifier": ("ErrorPlot", "FeatureImportance", "ConfusionMatrix"),
    "randomforestclassifier": ("FeatureImportance", "ErrorPlot", "ConfusionMatrix"),
    "randomforestregressor": ("FeatureImportance", "ErrorPlot"),
    "dbscan": ("Scatter", "ElbowPlot"),
    "kmeans": ("Scatter", "ElbowPlot"),
    "agglomerativeclustering": ("Scatter", "Dendrogram"),
}


def model_key(name: str) -> str:
    return name.lower().replace("_", "")


def chart_menu(spark: SparkSession) -> DataFrame:
    """(model, chart, position) lookup table."""
    rows = [(m, c, i) for m, cs in CHARTS.items() for i, c in enumerate(cs)]
    return spark.createDataFrame(rows, "model string, chart string, position int")


def available_charts(model: str) -> tuple[str, ...]:
    return CHARTS.get(model_key(model), ())


def dispatch(model: str, chart: str, builders: dict[str, Callable[[], DataFrame]]) -> DataFrame:
    """Build the data of ``chart`` if the model supports it."""
    if chart not in available_charts(model):
        raise ValueError(f"chart {chart!r} is not available for {model!r}")
    if chart not in builders:
        raise ValueError(f"no data for chart {chart!r}")
    return builders[chart]()


def scatter_points(pred: DataFrame, features: Sequence[str], key: str, label: str = "y_pred") -> DataFrame:
    """V1: first two features and the label; with one feature, row index + value."""
    if len(features) >= 2:
        return pred.select(key, F.col(features[0]).alias("x"), F.col(features[1]).alias("y"),
                           F.col(label).alias("label"))
    idx = row_positions(pred.select(key, features[0], label), [key])
    return idx.select(key, F.col("index").cast("double").alias("x"), F.col(features[0]).alias("y"),
                      F.col(label).alias("label"))


def line_series(pred: DataFrame, key: str) -> DataFrame:
    """V2: sample index, y_true, y_pred (distributed row numbering)."""
    return row_positions(pred.select(key, "y_true", "y_pred"), [key]).select(
        "index", key, "y_true", "y_pred")


def residual_series(pred: DataFrame, key: str) -> DataFrame:
    """V3: sample index and residual."""
    return line_series(pred, key).select("index", key, residual("y_true", "y_pred").alias("residual"))


def grid_axis(lo: float, hi: float, step: float = GRID_STEP, margin: float = GRID_MARGIN):
    """start and number of points of ``arange(lo - margin, hi + margin, step)``."""
    start, stop = lo - margin, hi + margin
    return start, max(0, int(math.ceil((stop - start) / step)))


def boundary_grid(spark: SparkSession, x_range: tuple[float, float], y_range: tuple[float, float],
                  step: float = GRID_STEP, margin: float = GRID_MARGIN) -> DataFrame:
    """V8: the 2-D prediction grid, generated by ``spark.range`` (distributed, no
    join of the two axes): ``i, j, x, y``."""
    x0, nx = grid_axis(*x_range, step, margin)
    y0, ny = grid_axis(*y_range, step, margin)
    g = spark.range(nx * ny)
    return g.select((F.col("id") / ny).cast("long").alias("i"), (F.col("id") % ny).alias("j")).select(
        "i", "j", (F.lit(x0) + F.col("i") * F.lit(step)).alias("x"),
        (F.lit(y0) + F.col("j") * F.lit(step)).alias("y"))


def boundary_predictions(spark: SparkSession, features: Sequence[str],
                         x_range: tuple[float, float], y_range: tuple[float, float],
                         predict: Callable[[DataFrame], DataFrame],
                         step: float = GRID_STEP, margin: float = GRID_MARGIN) -> DataFrame:
    """V8: predictions over the decision-boundary grid of a 2-feature model.
    ``predict`` maps a DataFrame with the two feature columns to one with a
    ``prediction`` column (``model.transform`` of a pipeline, or a neighbour vote)."""
    if len(features) != 2:
        raise ValueError(f"a decision boundary needs exactly 2 features, got {len(features)}")
    g = boundary_grid(spark, x_range, y_range, step, margin)
    g = g.select("i", "j", F.col("x").alias(features[0]), F.col("y").alias(features[1]))
    return predict(g).select("i", "j", F.col(features[0]).alias("x"), F.col(features[1]).alias("y"),
                             "prediction")


def feature_importance(spark: SparkSession, model, features: Sequence[str]) -> DataFrame:
    """V7: ``feature, importance`` sorted by importance (descending)."""
    imp = model.featureImportances.toArray()
    rows = [(f, float(v)) for f, v in zip(features, imp)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(
        F.desc("importance"), "feature")


def tree_nodes(spark: SparkSession, model, path: str) -> DataFrame:
    """V6: the node table of a fitted tree, read back from its saved form."""
    model.write().overwrite().save(path)
    return spark.read.parquet(f"{path}/data")


def elbow_curve(df: DataFrame, features: str = "features", k_max: int | None = None,
                seed: int = 42) -> DataFrame:
    """Inertia for k = 1..min(10, n/2 - 1). k = 1 is ``n * var_pop`` summed
    over dimensions (Spark rejects k = 1); k >= 2 is the k-means model's own inertia.
    The input is written once for all fits."""
    from pyspark.ml.functions import vector_to_array
    spark = df.sparkSession
    df = materialize(df.select(features), "elbow")
    n = df.count()
    k_max = k_max if k_max is not None else min(11, n // 2) - 1
    arr = df.select(vector_to_array(features).alias("v"))
    d = arr.select(F.size("v")).first()[0]
    k1 = arr.select(*[F.col("v")[i].alias(f"x{i}") for i in range(d)]).agg(
        *[(F.var_pop(f"x{i}") * F.count(F.lit(1))).alias(f"s{i}") for i in range(d)]).first()
    rows = [(1, float(sum(k1)))] if k_max >= 1 else []
    for k in range(2, k_max + 1):
        m = kmeans(k, features).setSeed(seed).fit(df)
        rows.append((k, float(m.summary.trainingCost)))
    return spark.createDataFrame(rows, "k int, inertia double")


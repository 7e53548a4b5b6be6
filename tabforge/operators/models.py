"""Model estimators (M1-M5, M7-M10, M12) as ``pyspark.ml`` Pipelines.

Each reference model name maps to a Spark ML estimator with parameters that
reproduce the reference's defaults where Spark allows it:

* linear / multiple regression: ordinary least squares (normal equations)
* polynomial regression: PolynomialExpansion + OLS
* logistic regression: multinomial, L2 with C = 1 -> regParam = 1 / (C n)
* decision tree: regressor or classifier by the continuity test; Spark's depth
  limit is 30 (the reference grows without limit)
* SVM (RBF): random Fourier features (Rahimi and Recht, 2007) + one-vs-rest
  linear SVM - an approximation of the kernel machine that scales with rows
* bagging: 10 bootstrap trees on all features; random forests: 100 trees
* k-means: k = 8, k-means|| initialisation, seed 42

Everything is seeded (the reference leaves trees, forests and k-means unseeded).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import (DecisionTreeClassifier, LinearSVC, LogisticRegression,
                                       OneVsRest, RandomForestClassifier)
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PolynomialExpansion, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabforge.session import materialize

SEED = 42
# The 13 model names of the reference, in its order.
MODEL_NAMES = ("Linear_Regression", "Multiple_Regression", "Polynomial_Regression",
               "Logistic_Regression", "Decision_Tree", "KNN", "SVM", "Bagging_Classifier",
               "Random_Forest_Classifier", "Random_Forest_Regressor", "DBSCAN", "KMeans",
               "Agglomerative_Clustering")
CLASSIFY_BINNED = ("logistic_regression", "svm", "bagging_classifier", "random_forest_classifier")
CLUSTERING = ("dbscan", "kmeans", "agglomerative_clustering")
MANY_PASSES = ("svm", "logistic_regression", "decision_tree", "bagging_classifier", "random_forest_classifier",
               "random_forest_regressor")
TREE_MAX_DEPTH = 30  # Spark's limit; the reference's trees are unlimited
# Deep trees: cache each row's node id (one pass per level instead of re-routing
# every row through the tree), checkpoint that cache every 10 levels to the
# shared folder, and let more nodes be split per pass.
TREE_TUNING = dict(cacheNodeIds=True, checkpointInterval=10, maxMemoryInMB=1024)
#: Training rows of a partition above which a fit's input is dealt to more of them.
FIT_ROWS = 150_000
#: Partitions of a forest's training rows, up to FOREST_PARTS x FIT_ROWS of them.
FOREST_PARTS = 4
#: Trees x training rows of one fit. The driver holds a fit's trees, whose nodes grow with both.
FOREST_ROWS = 2_000_000


def assemble(df: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    """Feature vector from numeric columns, or from one array column."""
    types = dict(df.dtypes)
    if len(features) == 1 and types[features[0]].startswith("array"):
        return df.withColumn(out, array_to_vector(F.col(features[0]).cast("array<double>")))
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="error").transform(df)


def spread(train: DataFrame, rows: int | None = None) -> DataFrame:
    """``train`` in partitions of about ``rows`` rows at most. A fit keeps its rows in the input's
    partitions and reads them in every pass (a forest with a count per tree and row), and a
    small file is one partition however many rows it holds. Tables whose partitions hold no more
    are left as they are. No more partitions than that: each sends every node's sums in a pass."""
    rows = rows or FIT_ROWS
    sizes = [r["count"] for r in train.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    if max(sizes, default=0) <= rows:
        return train
    return train.repartition(-(-sum(sizes) // rows))


def gathered(train: DataFrame, rows: int | None = None) -> DataFrame:
    """``train`` in FOREST_PARTS partitions at most, or as many as ``rows`` rows each ask for. On
    every level each partition of a forest's input sends the sums of every node (features x bins x
    classes), also of those it holds no row of, so what is shuffled is nodes x partitions."""
    rows = rows or FIT_ROWS
    return spread(train.coalesce(max(FOREST_PARTS, -(-train.count() // rows))), rows)


def linear_regression(features="features", label="label") -> LinearRegression:
    """M1/M2: OLS with intercept."""
    return LinearRegression(featuresCol=features, labelCol=label, solver="normal",
                            regParam=0.0, elasticNetParam=0.0, fitIntercept=True)


def polynomial_regression(degree: int, features="features", label="label") -> Pipeline:
    """M3: polynomial terms of the given degree, then OLS."""
    return Pipeline(stages=[PolynomialExpansion(degree=degree, inputCol=features, outputCol="_tf_poly"),
                            linear_regression("_tf_poly", label)])


def logistic_regression(n_rows: int, c: float = 1.0, features="features", label="label") -> LogisticRegression:
    """M4: multinomial, L2 penalty 1/(2C) |w|^2 on the summed loss = regParam 1/(C n)
    on Spark's averaged loss; 1000 iterations; raw (already scaled) features."""
    return LogisticRegression(featuresCol=features, labelCol=label, family="multinomial",
                              maxIter=1000, regParam=1.0 / (c * max(n_rows, 1)), elasticNetParam=0.0,
                              standardization=False, tol=1e-6)


def decision_tree(continuous: bool, features="features", label="label", max_depth: int = TREE_MAX_DEPTH):
    """M5: regressor for a continuous target, classifier otherwise."""
    cls = DecisionTreeRegressor if continuous else DecisionTreeClassifier
    return cls(featuresCol=features, labelCol=label, maxDepth=max_depth, maxBins=32, seed=SEED, **TREE_TUNING)


def bagging(features="features", label="label", max_depth: int = TREE_MAX_DEPTH) -> RandomForestClassifier:
    """M8: 10 bootstrap trees, every feature considered at each split."""
    return RandomForestClassifier(featuresCol=features, labelCol=label, numTrees=10,
                                  featureSubsetStrategy="all", bootstrap=True, subsamplingRate=1.0,
                                  maxDepth=max_depth, seed=SEED, **TREE_TUNING)


def forest_classifier(features="features", label="label", max_depth: int = TREE_MAX_DEPTH):
    """M9: 100 trees, sqrt(features) per split."""
    return RandomForestClassifier(featuresCol=features, labelCol=label, numTrees=100,
                                  featureSubsetStrategy="sqrt", maxDepth=max_depth, seed=SEED, **TREE_TUNING)


def forest_regressor(features="features", label="label", max_depth: int = TREE_MAX_DEPTH):
    """100 trees, all features per split."""
    return RandomForestRegressor(featuresCol=features, labelCol=label, numTrees=100,
                                 featureSubsetStrategy="all", maxDepth=max_depth, seed=SEED, **TREE_TUNING)


def tree_groups(forest, n_train: int) -> list:
    """``forest`` itself, or, where trees x training rows are more than FOREST_ROWS, estimators of
    fewer trees each (one at least), with seeds of their own, that have its trees together."""
    trees = forest.getNumTrees()
    per = max(1, FOREST_ROWS // max(n_train, 1))
    if per >= trees:
        return [forest]
    return [forest.copy({forest.numTrees: min(per, trees - i), forest.seed: forest.getSeed() + 1_000_003 * i})
            for i in range(0, trees, per)]


def forest_predictions(forest, train: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` with the ``prediction`` of ``forest`` fit on ``train``. A large forest is fit group
    by group: each group's votes (sums over its trees, as the whole forest adds them) are written
    before the next is fit, so the driver holds one group's trees at a time."""
    train = gathered(train)
    groups = tree_groups(forest, train.count())
    if len(groups) == 1:
        return forest.fit(train).transform(rows).select(*rows.columns, "prediction")
    row, vote = "_tf_row", "_tf_vote"
    rows = materialize(rows.withColumn(row, F.monotonically_increasing_id()), "forest-rows")
    votes, classify, size = None, isinstance(forest, RandomForestClassifier), 1
    for g in groups:
        m = g.fit(train)
        size = m.numClasses if classify else 1
        own = vector_to_array("rawPrediction") if classify else F.array(F.col("prediction") * g.getNumTrees())
        part = materialize(m.transform(rows).select(row, own.alias(vote)), "forest-votes")
        votes = part if votes is None else votes.unionByName(part)
        del m
    total = F.array(*[F.sum(F.col(vote)[i]) for i in range(size)])
    if classify:  # the first of the largest, as in the whole forest
        decided = (F.array_position(F.col(vote), F.array_max(vote)) - 1).cast("double")
    else:
        decided = F.col(vote)[0] / forest.getNumTrees()
    decided = votes.groupBy(row).agg(total.alias(vote)).select(row, decided.alias("prediction"))
    return rows.join(decided, row).drop(row)


def kmeans(k: int = 8, features="features", prediction="cluster") -> KMeans:
    """K-means, k-means|| start, seed 42."""
    return KMeans(k=k, featuresCol=features, predictionCol=prediction, initMode="k-means||",
                  seed=SEED, maxIter=300, tol=1e-4)


# ---- M7: RBF kernel approximated by random Fourier features -------------------------
def rbf_gamma_scale(df: DataFrame, features: Sequence[str]) -> float:
    """gamma = 'scale' = 1 / (n_features * variance of all feature values), one aggregate."""
    types = dict(df.dtypes)
    if len(features) == 1 and types[features[0]].startswith("array"):
        vals = df.select(F.explode(F.col(features[0]).cast("array<double>")).alias("v"))
        d = df.select(F.size(features[0])).first()[0]
        var = vals.agg(F.var_pop("v")).first()[0]
    else:
        d = len(features)
        vals = df.select(F.explode(F.array(*[F.col(f).cast("double") for f in features])).alias("v"))
        var = vals.agg(F.var_pop("v")).first()[0]
    return 1.0 / (d * var) if var else 1.0


def fourier_features(x: Column, d_in: int, gamma: float, n_components: int = 200,
                     seed: int = SEED) -> Column:
    """z(x) = sqrt(2/D) cos(W x + b), W ~ N(0, 2 gamma), b ~ U(0, 2 pi): a vectorised
    (Arrow batch, numpy matmul) map of an array<double> column. W and b are
    d_in x D numbers fixed by the seed (small, shipped with the function)."""
    rng = np.random.default_rng(seed)
    w = rng.normal(0.0, math.sqrt(2.0 * gamma), size=(d_in, n_components))
    b = rng.uniform(0.0, 2 * math.pi, size=n_components)
    scale = math.sqrt(2.0 / n_components)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def rff(s: pd.Series) -> pd.Series:
        if len(s) == 0:
            return pd.Series([], dtype=object)
        m = np.vstack(s.to_numpy())
        z = scale * np.cos(m @ w + b)
        return pd.Series(list(z))

    return rff(x)


def svm_rbf(df: DataFrame, features: Sequence[str], label: str, n_components: int = 200,
            max_iter: int = 50, parallelism: int = 4):
    """M7: returns (transform(df) -> df with 'features', estimator) for the RFF SVM."""
    types = dict(df.dtypes)
    if len(features) == 1 and types[features[0]].startswith("array"):
        arr = F.col(features[0]).cast("array<double>")
        d_in = df.select(F.size(features[0])).first()[0]
    else:
        arr = F.array(*[F.col(f).cast("double") for f in features])
        d_in = len(features)
    gamma = rbf_gamma_scale(df, features)
    z = fourier_features(arr, d_in, gamma, n_components)

    def prepare(frame: DataFrame) -> DataFrame:
        return frame.withColumn("features", array_to_vector(z))

    prepare.gamma = gamma
    svc = LinearSVC(maxIter=max_iter, regParam=1.0 / max(df.count(), 1), standardization=False)
    return prepare, OneVsRest(classifier=svc, featuresCol="features", labelCol=label,
                              parallelism=parallelism)


def probabilities(df: DataFrame, col: str = "probability", out: str = "y_prob") -> DataFrame:
    """Probability vector as array<double>."""
    return df.withColumn(out, vector_to_array(F.col(col)))

"""The model runner: entry 3 of the reference (continuity test, optional target
binning, polynomial degree, hash split, fit, predictions, metrics, timing).

``run_model(prep, "KNN")`` returns a ``RunResult`` with the fitted model(s), a
predictions DataFrame (key, X, y_true, y_pred[, y_prob], is_test) or cluster
labels, a one-row metrics DataFrame and a run record.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.operators import density, hierarchy, metrics, models, neighbors, profile, scale, split
from tabforge.plans.prep import PrepResult
from tabforge.sources.sinks import run_report


@dataclass
class RunResult:
    model_type: str
    model: object
    predictions: DataFrame
    metrics: DataFrame
    training_time: float
    status: str
    continuous: bool
    extra: dict

    def report(self):
        row = self.metrics.first().asDict() if self.metrics is not None else {}
        num = {k: v for k, v in row.items() if isinstance(v, (int, float)) and not isinstance(v, bool)}
        n = self.predictions.count()
        n_test = self.predictions.where("is_test").count() if "is_test" in self.predictions.columns else 0
        return run_report(self.predictions.sparkSession, self.model_type, self.status, self.training_time,
                          n, n - n_test, n_test, num)


def is_continuous(df: DataFrame, y: str = "y") -> bool:
    """P9 on the target."""
    return bool(profile.continuity(df, [y]).first()["is_continuous"])


def run_model(prep: PrepResult, model_type: str, k_neighbors: int = 5,
              scaler_fit_on: str = "train", degree: int = 3, ward_leaves: int | None = None) -> RunResult:
    """``degree`` is the polynomial regression's (the same at every table size).
    ``ward_leaves`` None merges every row (n * n distances); large tables pass a number of
    k-means leaves to merge instead.
    ``scaler_fit_on="all"`` reproduces the reference, which fits the scalers on
    every row before splitting (T12); the default fits them on train rows only."""
    if scaler_fit_on not in ("train", "all"):
        raise ValueError("scaler_fit_on must be 'train' or 'all'")
    mt = model_type.lower()
    if mt not in [m.lower() for m in models.MODEL_NAMES]:
        raise ValueError(f"unknown model {model_type!r}")
    t0 = time.time()
    data = prep.data
    cont = is_continuous(data)
    if mt in models.CLASSIFY_BINNED and cont:
        data = scale.quantile_bins(data, "y", "y")
        cont = False
    key, feats = prep.key, prep.features
    if mt in models.CLUSTERING:
        std = scale.standard_scale(data, prep.scaled)
        res = _cluster(std, mt, key, feats, ward_leaves)
        return RunResult(model_type, res[0], res[1], res[2], time.time() - t0, "ok", cont, {})
    data = split.hash_split(data, key)
    train_raw = data.where(~F.col("is_test"))
    scaler = scale.scaler_stats(train_raw if scaler_fit_on == "train" else data, prep.scaled)
    std = scale.apply_standard(data, prep.scaled, scaler)
    std = models.assemble(std, feats).withColumn("label", F.col("y").cast("double"))
    train = std.where(~F.col("is_test"))
    extra: dict = {"scaler": scaler}
    if mt == "knn":
        pred, model = _knn(std, key, feats, cont, k_neighbors)
    else:
        est, prepare = _estimator(mt, train, cont, feats, degree)
        fit_in = models.spread(train) if mt in models.MANY_PASSES else train
        model = est.fit(prepare(fit_in) if prepare else fit_in)
        out = model.transform(prepare(std) if prepare else std)
        extra["gamma"] = getattr(prepare, "gamma", None)
        cols = [key, *feats, "is_test", F.col("y").alias("y_true"), F.col("prediction").alias("y_pred")]
        if "probability" in out.columns:
            out = models.probabilities(out)
            cols.append("y_prob")
        elif "rawPrediction" in out.columns:
            # SVM has no probabilities: its per-class decision scores rank the
            # same way, which is all a ROC curve needs
            out = models.probabilities(out, "rawPrediction")
            cols.append("y_prob")
        pred = out.select(*cols)
    test = pred.where("is_test")
    mdf = metrics.regression_metrics(pred) if cont else metrics.accuracy(test)
    if mt in ("polynomial_regression",):
        extra["degree"] = degree
    mdf.first()  # force the work inside the timer (Spark is lazy)
    return RunResult(model_type, model, pred, mdf, time.time() - t0, "ok", cont, extra)


def _estimator(mt: str, train: DataFrame, cont: bool, feats, degree: int):
    if mt in ("linear_regression", "multiple_regression"):
        return models.linear_regression(), None
    if mt == "polynomial_regression":
        return models.polynomial_regression(degree), None
    if mt == "logistic_regression":
        return models.logistic_regression(train.count()), None
    if mt == "decision_tree":
        return models.decision_tree(cont), None
    if mt == "bagging_classifier":
        return models.bagging(), None
    if mt == "random_forest_classifier":
        return models.forest_classifier(), None
    if mt == "random_forest_regressor":
        return models.forest_regressor(), None
    if mt == "svm":
        arr = train.withColumn("_x", F.array(*[F.col(f"`{f}`").cast("double") for f in feats]))
        prepare, ovr = models.svm_rbf(arr, ["_x"], "label")

        def prep(frame: DataFrame) -> DataFrame:
            f = frame.withColumn("_x", F.array(*[F.col(f"`{c}`").cast("double") for c in feats]))
            return prepare(f.drop("features"))
        prep.gamma = prepare.gamma
        return ovr, prep
    raise ValueError(mt)


def _knn(std: DataFrame, key: str, feats, cont: bool, k: int):
    vec = F.array(*[F.col(f"`{f}`").cast("double") for f in feats])
    base = std.select(F.col(key).alias("id"), vec.alias("vec"), F.col("y").alias("label"), "is_test")
    train = base.where(~F.col("is_test")).drop("is_test")
    nb = neighbors.knn(train, base.select("id", "vec"), k)
    if cont:
        p = neighbors.regress(nb)
    else:
        p = neighbors.vote(nb)
    pred = (std.select(key, *feats, "is_test", F.col("y").alias("y_true"))
            .join(p.withColumnRenamed("q_id", key), key))
    return pred, None


def _cluster(std: DataFrame, mt: str, key: str, feats, ward_leaves: int | None):
    vec = F.array(*[F.col(f"`{f}`").cast("double") for f in feats])
    base = std.select(key, *feats, vec.alias("_v"))
    if mt == "dbscan":
        lab = density.dbscan(base, key, "_v")
        model = None
    elif mt == "kmeans":
        fe = models.assemble(std, feats)
        model = models.kmeans(8).fit(fe)
        lab = model.transform(fe).select(key, F.col("cluster").cast("long"))
    else:
        lab, link = hierarchy.ward(base, key, "_v", 2, ward_leaves)
        model = link
    pred = base.drop("_v").join(lab.select(key, "cluster"), key)
    return model, pred, profile.cluster_counts(pred, "cluster")


"""Metrics (X1-X6) as aggregates over a predictions DataFrame.

Predictions carry ``y_true``, ``y_pred`` and, for supervised runs, the boolean
``is_test``. Every metric is one or two aggregates; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.functions.scalar import r2_grade
from tabforge.operators.ordinal import ordered_cumsum

def regression_metrics(pred: DataFrame, y: str = "y_true", p: str = "y_pred",
                       split_col: str = "is_test") -> DataFrame:
    """``n_test, mse_train, mse_test, mse_diff (train - test), r2 (test), grade``.
    ONE pass over the predictions: per split the count, sum of squared errors and
    population variance of y (merged stably over tasks, two rows after the shuffle);
    SST = n * variance. A constant y has no R2 (NULL, grade low)."""
    e = F.col(y) - F.col(p)
    per = pred.groupBy(split_col).agg(
        F.count(F.lit(1)).alias("n"), F.sum(e * e).alias("sse"),
        F.var_pop(F.col(y)).alias("var"))
    sst = F.col("var") * F.col("n")
    piv = per.agg(
        F.max(F.when(~F.col(split_col), F.col("sse") / F.col("n"))).alias("mse_train"),
        F.max(F.when(F.col(split_col), F.col("sse") / F.col("n"))).alias("mse_test"),
        F.max(F.when(F.col(split_col), 1 - F.try_divide(F.col("sse"), sst))).alias("r2"),
        F.max(F.when(F.col(split_col), F.col("n"))).cast("long").alias("n_test"))
    return piv.select("n_test", "mse_train", "mse_test",
                      (F.col("mse_train") - F.col("mse_test")).alias("mse_diff"), "r2",
                      r2_grade(F.col("r2")).alias("grade"))


def accuracy(pred: DataFrame, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """``n, accuracy, error_rate``."""
    return pred.agg(F.count(F.lit(1)).cast("long").alias("n"),
                    F.avg((F.col(y) == F.col(p)).cast("double")).alias("accuracy")
                    ).withColumn("error_rate", 1 - F.col("accuracy"))


def confusion_matrix(pred: DataFrame, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """Long form ``y_true, y_pred, n`` over the union of labels, zero cells
    included. Counts come from one groupBy; the cells are the label set exploded
    against itself (k * k rows are the result's own size), joined to the counts."""
    counts = pred.groupBy(F.col(y).alias("y_true"), F.col(p).alias("y_pred")).agg(
        F.count(F.lit(1)).alias("n"))
    labels = (counts.select(F.col("y_true").alias("label"))
              .union(counts.select(F.col("y_pred").alias("label"))).distinct())
    every = labels.where(F.col("label").isNotNull()).agg(F.collect_list("label").alias("labels"))
    cells = (every.select(F.explode("labels").alias("y_true"), "labels")
             .select("y_true", F.explode("labels").alias("y_pred")))
    return (cells.join(counts, ["y_true", "y_pred"], "left")
            .select("y_true", "y_pred", F.coalesce("n", F.lit(0)).cast("long").alias("n")))


def _roc_table(scored: DataFrame, y: str, score: str, cls: str) -> DataFrame:
    """Per class and distinct threshold (descending): counts at the threshold,
    cumulative counts, position and class totals."""
    g = scored.groupBy(cls, F.col(score).cast("double").alias("threshold")).agg(
        F.sum(F.col(y).cast("long")).alias("tp_n"),
        F.sum((1 - F.col(y)).cast("long")).alias("fp_n")).withColumn("one", F.lit(1))
    cum = ordered_cumsum(g, [("threshold", False)],
                         {"tps": "tp_n", "fps": "fp_n", "pos": "one"}, group_cols=[cls])
    tot = g.groupBy(cls).agg(F.sum("tp_n").alias("P"), F.sum("fp_n").alias("N"))
    return cum.join(F.broadcast(tot), cls)  # one row per class


def roc_points(scored: DataFrame, y: str, score: str, cls: str = "class",
               drop_intermediate: bool = True) -> DataFrame:
    """One-vs-rest ROC points per class. ``scored`` has one row per
    (example, class) with ``y`` = 1 for a positive. Points are the distinct
    thresholds in descending order plus (0, 0) first; collinear points are
    dropped as the common ROC routine does. Running counts come from the
    distributed running sum and neighbours from an equi-join on the position, so
    no class is ever held in a single task."""
    t = _roc_table(scored, y, score, cls)
    if drop_intermediate:
        nxt = t.select(cls, (F.col("pos") - 1).alias("pos"), F.col("fp_n").alias("_nfp"),
                       F.col("tp_n").alias("_ntp"))
        t = t.join(nxt, [cls, "pos"], "left").where(
            (F.col("pos") == 1) | F.col("_nfp").isNull()
            | (F.col("_nfp") != F.col("fp_n")) | (F.col("_ntp") != F.col("tp_n")))
    pts = t.select(cls, F.col("pos").cast("long"), "threshold", "tps", "fps", "P", "N")
    first = (t.where(F.col("pos") == 1)
             .select(cls, F.lit(0).cast("long").alias("pos"), F.lit(None).cast("double").alias("threshold"),
                     F.lit(0).cast("long").alias("tps"), F.lit(0).cast("long").alias("fps"), "P", "N"))
    allp = pts.unionByName(first)
    return allp.select(cls, "pos", "threshold",
                       F.when(F.col("N") > 0, F.col("fps") / F.col("N")).alias("fpr"),
                       F.when(F.col("P") > 0, F.col("tps") / F.col("P")).alias("tpr"))


def roc_auc(scored: DataFrame, y: str, score: str, cls: str = "class") -> DataFrame:
    """Trapezoid area under each class's ROC curve. Each threshold adds
    ``dFPR * (TPR_prev + TPR) / 2`` and both terms follow from the row's own
    running and step counts, so the area is a plain grouped sum. A class without
    positives or without negatives has no area (NULL)."""
    t = _roc_table(scored, y, score, cls)
    area = F.try_divide(F.col("fp_n"), F.col("N")) * F.try_divide(2 * F.col("tps") - F.col("tp_n"), F.col("P")) / 2
    return t.groupBy(cls).agg(F.sum(area).alias("auc"))


def inertia(assigned: DataFrame, features: str, center: str) -> DataFrame:
    """Sum of squared distances of rows to their own centre (array columns)."""
    d2 = F.aggregate(F.zip_with(F.col(features), F.col(center), lambda a, b: (a - b) * (a - b)),
                     F.lit(0.0), lambda acc, v: acc + v)
    return assigned.agg(F.sum(d2).alias("inertia"))

"""A saved run that scores raw tables.

A folder holds the preparation's fitted rules (one-hot values, means, label dictionaries),
the scaler statistics, the feature order and the fitted estimator. ``load_run(...).score``
takes a table as it was before preparation.
"""

from __future__ import annotations

import importlib
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabforge.operators import clean, models, scale
from tabforge.plans.prep import PrepResult, Rule
from tabforge.plans.runner import RunResult


def save_run(prep: PrepResult, result: RunResult, path: str) -> str:
    """Writes ``path/plan`` (JSON), ``path/codes_<i>`` (parquet), ``path/model``. Runs
    without an estimator (nearest neighbours, clustering) keep no model to save."""
    if result.model is None or not hasattr(result.model, "write"):
        raise ValueError(f"{result.model_type} has no estimator to save")
    spark = prep.data.sparkSession
    rules = []
    for i, r in enumerate(prep.rules):
        rules.append({"column": r.column, "kind": r.kind, "values": r.values, "mean": r.mean, "dtype": r.dtype})
        if r.codes is not None:
            r.codes.write.mode("overwrite").parquet(f"{path}/codes_{i}")
    cls = type(result.model)
    plan = {"rules": rules, "features": prep.features, "scaled": prep.scaled, "scaler": result.extra["scaler"],
            "gamma": result.extra.get("gamma"), "model": [cls.__module__, cls.__name__]}
    spark.createDataFrame([(json.dumps(plan),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/plan")
    result.model.write().overwrite().save(f"{path}/model")
    return path


@dataclass
class SavedRun:
    rules: list[Rule]
    features: list[str]
    scaled: list[str]
    scaler: dict
    gamma: float | None
    model: object

    def score(self, raw: DataFrame, key: str) -> DataFrame:
        """(key, prediction) of the rows whose features can all be derived (a value that
        the dictionaries do not know cannot)."""
        d = raw
        for r in self.rules:
            d = r.apply(d)
        d = clean.drop_incomplete(d.select(key, *[F.col(f"`{f}`") for f in self.features]))
        d = scale.apply_standard(d, self.scaled, self.scaler)
        if self.gamma is not None:
            x = F.array(*[F.col(f"`{f}`").cast("double") for f in self.features])
            z = models.fourier_features(x, len(self.features), self.gamma)
            d = d.withColumn("features", models.array_to_vector(z))
        else:
            d = models.assemble(d, self.features)
        return self.model.transform(d).select(key, "prediction")


def load_run(spark: SparkSession, path: str) -> SavedRun:
    plan = json.loads(spark.read.text(f"{path}/plan").first()[0])
    rules = []
    for i, r in enumerate(plan["rules"]):
        rule = Rule(**r)
        if rule.kind == "label":
            rule.codes = spark.read.parquet(f"{path}/codes_{i}")
        rules.append(rule)
    module, name = plan["model"]
    model = getattr(importlib.import_module(module), name).load(f"{path}/model")
    return SavedRun(rules, plan["features"], plan["scaled"], plan["scaler"], plan["gamma"], model)

"""A saved run scores raw tables as the run in memory did."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabforge.plans import prep as P
from tabforge.plans import runner as R
from tabforge.plans import saved
from tabforge.session import scratch_path


@pytest.fixture(scope="module")
def people(spark):
    rng = np.random.default_rng(1)
    rows = [(i, f"{5 + i % 2}-{i % 12}", f"{100 + i} lb", ["x", "y", "z"][i % 3], f"n{i}", "A,B" if i % 2 else "C",
             float(rng.normal() + i % 3), int(i % 3)) for i in range(90)]
    return spark.createDataFrame(rows, "k long, height string, weight string, kind string, name string, city string, v double, y long")


@pytest.mark.parametrize("model", ["Random_Forest_Classifier", "SVM"])
def test_saved_run_scores_raw_rows(spark, people, model):
    x = ["height", "weight", "kind", "name", "city", "v"]
    prep = P.preprocess(people, x, "y", key="k", is_categorical=True)
    run = R.run_model(prep, model)
    path = saved.save_run(prep, run, scratch_path(spark, f"saved-{model}"))
    scored = saved.load_run(spark, path).score(people.select("k", *x), "k")
    both = run.predictions.select("k", "y_pred").join(scored, "k")
    assert both.count() == 90 and both.where(F.col("y_pred") != F.col("prediction")).isEmpty()
    unseen = people.limit(1).withColumn("name", F.lit("nobody")).select("k", *x)
    assert saved.load_run(spark, path).score(unseen, "k").count() == 0


def test_runs_without_estimator_are_refused(spark, people):
    prep = P.preprocess(people, ["v"], "y", key="k", is_categorical=True)
    with pytest.raises(ValueError):
        saved.save_run(prep, R.run_model(prep, "KNN"), scratch_path(spark, "saved-knn"))

"""Large forests are fit group by group; small ones as before."""

import numpy as np
from pyspark.sql import functions as F

from tabforge.operators import models


def _rows(spark, n=240):
    rng = np.random.default_rng(1)
    rows = [(i // 2, float(i % 3), [float(i % 3) + rng.normal() * 0.2, float(rng.normal())]) for i in range(n)]
    rows[0] = (None, *rows[0][1:])
    return models.assemble(spark.createDataFrame(rows, "k long, label double, v array<double>"), ["v"])


def test_groups_have_all_trees(monkeypatch, spark):
    f = models.forest_classifier()
    assert models.tree_groups(f, 1400) == [f]  # sf0.1
    groups = models.tree_groups(f, 700_000)
    assert sum(g.getNumTrees() for g in groups) == 100 and len({g.getSeed() for g in groups}) == len(groups)
    assert max(g.getNumTrees() for g in groups) * 700_000 <= models.FOREST_ROWS
    assert all(g.getMaxDepth() == 30 and g.getFeatureSubsetStrategy() == "sqrt" for g in groups)
    assert {g.getNumTrees() for g in models.tree_groups(models.bagging(), 10 ** 8)} == {1}


def test_votes_of_groups_make_the_forest(spark, monkeypatch):
    d = _rows(spark)
    small = models.RandomForestClassifier(numTrees=7, maxDepth=6, seed=3)
    whole = models.forest_predictions(small, d, d).select("k", "label", "prediction")
    assert sorted(map(tuple, small.fit(d).transform(d).select("k", "label", "prediction").fillna(-1).collect())) == sorted(
        map(tuple, whole.fillna(-1).collect()))
    fits, real = [], models.RandomForestClassifier.fit
    monkeypatch.setattr(models.RandomForestClassifier, "fit", lambda self, *a: fits.append(real(self, *a)) or fits[-1])
    monkeypatch.setattr(models, "FOREST_ROWS", 3 * 240)
    got = models.forest_predictions(small, d, d)
    assert got.columns == [*d.columns, "prediction"]
    assert [m.getNumTrees for m in fits] == [3, 3, 1]
    # repeated and NULL keys keep their rows; the votes are those of the fitted trees
    assert got.count() == 240 and got.where("k IS NULL").count() == 1
    assert got.where("label = prediction").count() > 230
    for r in got.limit(40).collect():
        votes = sum(m.predictRaw(r.features).toArray() for m in fits)
        assert r.prediction == float(votes.argmax())


def test_regression_is_the_mean_of_all_trees(spark, monkeypatch):
    d = _rows(spark)
    fits, real = [], models.RandomForestRegressor.fit
    monkeypatch.setattr(models.RandomForestRegressor, "fit", lambda self, *a: fits.append(real(self, *a)) or fits[-1])
    monkeypatch.setattr(models, "FOREST_ROWS", 2 * 240)
    got = models.forest_predictions(models.RandomForestRegressor(numTrees=5, maxDepth=4, seed=3), d, d)
    assert [m.getNumTrees for m in fits] == [2, 2, 1]
    for r in got.orderBy(F.xxhash64("features")).limit(40).collect():
        want = np.mean([t.predict(r.features) for m in fits for t in m.trees])
        assert abs(r.prediction - want) < 1e-9

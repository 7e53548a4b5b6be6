"""A forest's training rows come in few partitions: each sends every node's sums on every level."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabforge.operators import models


def test_forest_rows_are_gathered(spark, monkeypatch):
    rows = spark.range(0, 1200, 1, 12).withColumn("x", F.col("id") % 7)
    few = models.gathered(rows)
    assert few.rdd.getNumPartitions() == models.FOREST_PARTS
    assert sorted(r["id"] for r in few.collect()) == list(range(1200))
    assert models.gathered(spark.range(0, 9, 1, 2)).rdd.getNumPartitions() == 2  # never more than there are
    assert models.gathered(rows, rows=100).rdd.getNumPartitions() == 12  # no partition beyond the bound of a fit

    got = []
    train = models.assemble(rows.withColumn("label", (F.col("x") > 3).cast("double")), ["x"])
    forest = models.bagging(max_depth=3)
    fit = type(forest).fit
    monkeypatch.setattr(type(forest), "fit", lambda self, t: got.append(t.rdd.getNumPartitions()) or fit(self, t))
    out = models.forest_predictions(forest, train, train)
    assert got == [models.FOREST_PARTS]
    assert out.where(F.col("prediction") != F.col("label")).count() == 0

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabforge.operators import ordinal


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_cumsum_independent_of_partitioning(spark, parts):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 300), "x": rng.permutation(300), "w": rng.integers(1, 5, 300)})
    df = spark.createDataFrame(pdf).repartition(parts)
    out = ordinal.ordered_cumsum(df, ["x"], {"c": "w"}, group_cols=["g"], num_partitions=parts + 2).toPandas()
    exp = pdf.sort_values(["g", "x"]).assign(c=lambda d: d.groupby("g")["w"].cumsum())
    m = out.merge(exp, on=["g", "x"])
    assert (m["c_x"] == m["c_y"]).all() and len(m) == 300


def test_row_positions_and_codes(spark):
    df = spark.createDataFrame([(k,) for k in [5, 3, 9, 1]], "k long")
    pos = {r.k: r["index"] for r in ordinal.row_positions(df, ["k"], num_partitions=3).collect()}
    assert pos == {1: 0, 3: 1, 5: 2, 9: 3}
    codes = ordinal.dense_codes(spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "v string"), "v")
    assert sorted(map(tuple, codes.collect())) == [("a", 0), ("b", 1)]


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(7)
    vals = np.round(rng.normal(size=1001) * 10, 2)
    df = spark.createDataFrame([(float(v),) for v in vals], "y double").repartition(5)
    got = ordinal.exact_quantiles(df, "y", [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0])
    assert got == pytest.approx(list(np.quantile(vals, [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0])))


def test_cumsum_carries_across_arrow_batches(spark):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"g": rng.integers(0, 4, 500), "x": rng.permutation(500),
                        "w": rng.normal(size=500)})
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, "7")
    try:
        df = spark.createDataFrame(pdf)
        out = ordinal.ordered_cumsum(df, ["x"], {"c": "w"}, group_cols=["g"], num_partitions=3).toPandas()
        plain = ordinal.ordered_cumsum(df, ["x"], {"c": "w"}, num_partitions=3).toPandas()
    finally:
        spark.conf.set(key, old)
    exp = pdf.sort_values(["g", "x"]).assign(c=lambda d: d.groupby("g")["w"].cumsum())
    m = out.merge(exp, on=["g", "x"])
    assert np.allclose(m["c_x"], m["c_y"]) and len(m) == 500
    exp2 = pdf.sort_values("x").assign(c=lambda d: d["w"].cumsum())
    m2 = plain.merge(exp2, on=["x"])
    assert np.allclose(m2["c_x"], m2["c_y"])


def test_results_do_not_depend_on_partitioning(spark):
    """SURVEY 5.4: same result under repartition(1) and repartition(7)."""
    from tabforge.operators import density, encode, scale
    rng = np.random.default_rng(21)
    words = [f"w{int(i)}" for i in rng.integers(0, 40, 400)]
    pts = rng.uniform(0, 1, size=(400, 2))
    base = spark.createDataFrame([(i, words[i], float(pts[i, 0]), [float(x) for x in pts[i]])
                                  for i in range(400)], "k long, s string, y double, v array<double>")
    outs = []
    for n in (1, 7):
        df = base.repartition(n)
        codes = sorted(map(tuple, encode.label_encode(df, "s", "code").select("k", "code").collect()))
        edges = scale.quantile_edges(df, "y")
        clusters = sorted(map(tuple, density.dbscan(df, "k", "v", eps=0.08, min_samples=4)
                              .select("k", "cluster").collect()))
        outs.append((codes, edges, clusters))
    assert outs[0] == outs[1]


@pytest.mark.parametrize("reuse", ["true", "false"])
@pytest.mark.parametrize("aqe", ["true", "false"])
def test_exact_beyond_sampling_size_with_payload(spark, reuse, aqe):
    """300,000 rows, columns that one branch of the plan does not need, and no help
    from exchange reuse: positions and running sums stay exact."""
    n = 300_000
    old = {k: spark.conf.get(k) for k in ("spark.sql.exchange.reuse", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.exchange.reuse", reuse)
    spark.conf.set("spark.sql.adaptive.enabled", aqe)
    try:
        df = spark.range(n).select(((F.col("id") * 7919) % n).alias("k"), F.md5(F.col("id").cast("string")).alias("pad"),
                                   F.lit(1).alias("one"))
        pos = ordinal.row_positions(df, ["k"])
        assert pos.where(F.col("index") != F.col("k")).isEmpty() and pos.count() == n
        cum = ordinal.ordered_cumsum(df, [("k", False)], {"c": "one"})
        assert cum.where(F.col("c") != n - F.col("k")).isEmpty()
        got = ordinal.exact_quantiles(df, "k", [0.2, 0.5, 0.8])
        assert got == pytest.approx([0.2 * (n - 1), 0.5 * (n - 1), 0.8 * (n - 1)])
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_nulls_nan_ties_and_empty(spark):
    rows = [(None, 1), (float("nan"), 2), (1.0, 3), (1.0, 4), (-1.0, 5)]
    df = spark.createDataFrame(rows, "x double, i int")
    up = {r.i: r["index"] for r in ordinal.row_positions(df, ["x", "i"], num_partitions=4).collect()}
    assert up == {1: 0, 5: 1, 3: 2, 4: 3, 2: 4}
    down = {r.i: r["index"] for r in ordinal.row_positions(df, [("x", False), "i"], num_partitions=4).collect()}
    assert down == {2: 0, 3: 1, 4: 2, 5: 3, 1: 4}
    assert ordinal.row_positions(df.limit(0), ["x"]).collect() == []
    assert ordinal.exact_quantiles(df.limit(0), "x", [0.5]) == [None]

import pytest
from pyspark.sql import functions as F

from tabforge.operators import encode, scale


def test_scales(spark):
    df = spark.createDataFrame([(3.0, 1.0), (3.0, 2.0), (3.0, 5.0)], "k double, z double")
    mm = [tuple(r) for r in scale.minmax_scale(df, ["k", "z"]).collect()]
    assert mm == [(0.0, 0.0), (0.0, 0.25), (0.0, 1.0)]
    st = scale.standard_scale(df, ["k", "z"]).collect()
    import numpy as np
    z = np.array([1.0, 2.0, 5.0])
    want = (z - z.mean()) / z.std()
    assert [r.k for r in st] == [0.0, 0.0, 0.0]
    assert [r.z for r in st] == pytest.approx(list(want))


def test_bins(spark):
    df = spark.createDataFrame([(v,) for v in [1.0, 2.0, 4.0, 8.0, 16.0]], "y double")
    assert scale.quantile_edges(df, "y", [0.2, 0.25, 0.5, 0.75]) == pytest.approx([1.8, 2.0, 4.0, 8.0])
    b = scale.quantile_bins(df, "y").orderBy("y").collect()
    edges = scale.quantile_edges(df, "y")
    assert [r.bin for r in b] == [sum(1 for e in edges if v >= e) for v in [1, 2, 4, 8, 16]]
    rep = spark.createDataFrame([(v,) for v in [1.0, 1.0, 1.0, 1.0, 2.0]], "y double")
    assert scale.quantile_edges(rep, "y") == [1.0, pytest.approx(1.2)]


def test_label_and_one_hot(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, "b"), (4, "C")], "k int, s string")
    codes = {r.k: r.s for r in encode.label_encode(df, "s").collect()}
    assert codes == {1: 2, 2: 1, 3: 2, 4: 0}   # code-point order: C < a < b
    oh = encode.one_hot(df, "s").orderBy("k").collect()
    assert [(r["s_C"], r["s_a"], r["s_b"]) for r in oh] == [(0, 0, 1), (0, 1, 0), (0, 0, 1), (1, 0, 0)]


def test_split_one_hot(spark):
    df = spark.createDataFrame([(1, "x,p"), (2, "y,q"), (3, "x")], "k int, location string")
    out = encode.split_one_hot(df, "location").orderBy("k").collect()
    assert out[2]["location_part1_未知"] == 1 and out[0]["location_part0_x"] == 1


def test_polynomial_order_matches_spark(spark):
    from pyspark.ml.feature import PolynomialExpansion, VectorAssembler
    from pyspark.ml.functions import vector_to_array
    df = spark.createDataFrame([(2.0, 3.0, 5.0)], "a double, b double, c double")
    v = VectorAssembler(inputCols=["a", "b", "c"], outputCol="f").transform(df)
    pe = PolynomialExpansion(degree=3, inputCol="f", outputCol="p").transform(v)
    want = pe.select(vector_to_array("p")).first()[0]
    got = list(df.select(*scale.polynomial_columns(["a", "b", "c"], 3)).first())
    assert got == pytest.approx(want)
    assert len(got) == 19

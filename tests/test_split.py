"""Exact split: row counts, the SQL order, NULL and repeated keys."""

import hashlib
import math

from tabforge.operators.split import exact_split, train_test


def test_null_keys_are_in_exactly_one_side(spark):
    df = spark.createDataFrame([(1,), (2,), (None,), (None,), (3,)], "k int")
    train, test = train_test(df, "k")
    assert train.count() + test.count() == 5


def test_exactly_the_smallest_hashes(spark):
    for n in (1, 2, 3, 10, 997):
        rows = exact_split(spark.range(n).toDF("k"), "k").collect()
        order = sorted(range(n), key=lambda k: hashlib.md5(f"{k}-42".encode()).hexdigest())
        assert {r.k for r in rows if r.is_test} == set(order[:math.ceil(0.3 * n)]) and len(rows) == n


def test_repeated_and_missing_keys(spark):
    rows = [(None, i) for i in range(7)] + [(5, i % 2) for i in range(23)]
    out = exact_split(spark.createDataFrame(rows, "k int, v int"), "k").collect()
    assert len(out) == 30 and sum(r.is_test for r in out) == 9
    assert sorted((r.k is None, r.v) for r in out) == sorted((k is None, v) for k, v in rows)
    assert exact_split(spark.createDataFrame([], "k int"), "k").count() == 0

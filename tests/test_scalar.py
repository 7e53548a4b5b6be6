import pytest
from pyspark.sql import functions as F

from tabforge.functions import scalar as S


def test_height(spark):
    df = spark.createDataFrame([("6-2",), ("7-0",), ("x",), ("6-2-1",), (None,)], "h string")
    got = [r[0] for r in df.select(S.height_cm("h")).collect()]
    assert got[0] == pytest.approx(187.96) and got[1] == pytest.approx(213.36)
    assert got[2:] == [None, None, None]


def test_first_number(spark):
    df = spark.createDataFrame([("180 lb",), ("99.5kg",), ("n/a",)], "w string")
    assert [r[0] for r in df.select(S.first_number("w")).collect()] == [180.0, 99.5, None]


def test_dates(spark):
    texts = ["2024-01-05", "13/02/2024", "02/13/2024", "3/4/2024", "Jan 5, 2024", "2024/1/5",
             "2024-01-05 10:00", "x"]
    df = spark.createDataFrame([(t,) for t in texts], "d string")
    rows = df.select(*S.date_parts("d", "d")).collect()
    ymd = [(r[0], r[1], r[2]) for r in rows]
    assert ymd[0] == (2024, 1, 5)
    assert ymd[1] == (2024, 2, 13)
    assert ymd[2] == (2024, 2, 13)
    assert ymd[3] == (2024, 4, 3)      # day-first wins
    assert ymd[4] == (2024, 1, 5)
    assert ymd[5] == (2024, 1, 5)
    assert ymd[6] == (None, None, None)
    assert ymd[7] == (None, None, None)


def test_date_typed(spark):
    df = spark.sql("select timestamp'2024-01-05 10:30:00' as t, date'2024-02-01' as d")
    r = df.select(*S.date_parts("t", "t", "timestamp"), *S.date_parts("d", "d", "date")).first()
    assert (r.t_year, r.t_month, r.t_day, r.t_hour) == (2024, 1, 5, 10)
    assert (r.d_year, r.d_month, r.d_day, r.d_hour) == (2024, 2, 1, 0)


def test_places(spark):
    df = spark.createDataFrame([("a,b",), ("a,b,c",), ("z",)], "loc string")
    parts = df.select(*S.split_parts("loc", 3)).collect()
    assert [tuple(p) for p in parts] == [("a", "b", None), ("a", "b", "c"), ("z", None, None)]
    assert df.agg(S.contains_any("loc")).first()[0] is True


def test_grade_degree_number(spark):
    df = spark.createDataFrame([(0.9,), (0.6,), (0.1,)], "r double")
    assert [r[0] for r in df.select(S.r2_grade(F.col("r"))).collect()] == ["high", "medium", "low"]
    q = spark.range(1).select(S.poly_degree(F.lit(10000), F.lit(50)).alias("q"),
                              S.poly_degree(F.lit(150), F.lit(50)).alias("q2")).first()
    assert q.q == 50 and q.q2 == 2  # grows with the table; the runner takes the degree from its caller
    df2 = spark.createDataFrame([("$25,000,000 ",)], "s string")
    assert df2.select(S.parse_number("s")).first()[0] == 25000000.0

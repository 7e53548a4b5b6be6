import os

from tabforge.sources import csv as C
from tabforge.sources import sinks


def _write(path, text):
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def test_delimiters(spark, tmp_dir):
    for name, sep in [("comma", ","), ("semi", ";"), ("tab", "\t"), ("space", " "), ("pipe", "|")]:
        p = _write(os.path.join(tmp_dir, f"d_{name}.csv"),
                   sep.join(["a", "b", "c"]) + "\n" + "\n".join(sep.join(["1", "2", "3"]) for _ in range(5)) + "\n")
        assert C.detect_delimiter(spark, p) == sep, name
    p = _write(os.path.join(tmp_dir, "d_quoted.csv"), 'a;b\n"x,y,z";1\n"p,q";2\n')
    assert C.detect_delimiter(spark, p) == ";"
    p = _write(os.path.join(tmp_dir, "d_single.csv"), "a\n1\n2\n")
    assert C.detect_delimiter(spark, p) == ","


def test_bad_csv(spark, tmp_dir):
    p = _write(os.path.join(tmp_dir, "bad.csv"),
               "a,b,c\n1,2,3\n4,5\n6,7,8,9\nNA,null,None\nNaN,,x\n")
    good, rejects = C.read_table(spark, p, sep=",", with_rejects=True)
    rows = sorted([tuple(r) for r in good.collect()], key=str)
    assert len(rows) == 4                       # long row set aside
    assert rejects.count() == 1
    assert (4, 5, None) in [(r[0], r[1], r[2]) for r in good.collect()]
    assert dict(good.dtypes) == {"a": "bigint", "b": "bigint", "c": "string"}
    assert good.where("a is null and b is null and c is null").count() == 1


def test_parse_lines(spark):
    df = spark.createDataFrame([('1,"x,y",3',), ("1,2",), ("1,2,3,4",)], "value string")
    rows = C.parse_lines(df, ["a", "b", "c"]).collect()
    assert rows[0].status == "ok" and rows[0].b == "x,y"
    assert rows[1].status == "short" and rows[1].c is None
    assert rows[2].status == "long"


def test_csv_roundtrip_and_sinks(spark, tmp_dir):
    df = spark.createDataFrame([(1, "a", 1.5), (2, "b", 2.5)], "k long, s string, v double")
    path = os.path.join(tmp_dir, "rt")
    sinks.write_csv(df, path)
    back = C.read_table(spark, path)
    assert sorted(map(tuple, back.collect())) == [(1, "a", 1.5), (2, "b", 2.5)]
    rep = sinks.run_report(spark, "KMeans", "ok", 1.2, 10, 7, 3, {"inertia": 4.0})
    sinks.append_run_report(rep, os.path.join(tmp_dir, "runs"))
    sinks.append_run_report(rep, os.path.join(tmp_dir, "runs"))
    assert spark.read.parquet(os.path.join(tmp_dir, "runs")).count() == 2


def test_bom_blank_header_and_count(spark, tmp_dir):
    p = os.path.join(tmp_dir, "bom.csv")
    with open(p, "w", encoding="utf-8-sig", newline="") as f:
        f.write(',sepal length (cm),flower_class\r\n0,5.1,0\r\n1,4.9,1\r\n2,"4,7",1\r\n')
    df = C.read_table(spark, p)
    assert df.columns == ["_c0", "sepal length (cm)", "flower_class"]
    assert df.count() == 3                      # count() alone must work
    assert dict(df.dtypes)["sepal length (cm)"] == "string"   # "4,7" is text
    assert df.where("flower_class = 1").count() == 2


def test_non_utf8_encoding(spark, tmp_dir):
    # single-byte charset; Spark 4 accepts the standard charsets only
    # (others need spark.sql.legacy.javaCharsets)
    p = os.path.join(tmp_dir, "latin1.csv")
    with open(p, "w", encoding="iso-8859-1", newline="") as f:
        f.write("sales_name,année\ncafé,1\nthé,2\n")
    df = C.read_table(spark, p, encoding="iso-8859-1")
    assert df.columns == ["sales_name", "année"]
    assert sorted(r[0] for r in df.collect()) == ["café", "thé"]


def test_header_like_rows_and_quoted_line_breaks(spark, tmp_dir):
    p = _write(os.path.join(tmp_dir, "multi.csv"),
               'name,note,v\nann,"line one\nline two, still ""quoted""",1\nname,note,v\nbob,x,2\n"a,b","c\n\nd",3,4\nshort\n')
    good, rejects = C.read_table(spark, p, with_rejects=True)
    assert {tuple(r) for r in good.collect()} == {
        ("ann", 'line one\nline two, still "quoted"', "1"), ("name", "note", "v"), ("bob", "x", "2"), ("short", None, None)}
    assert rejects.count() == 1 and good.count() == 4


def test_number_and_boolean_texts(spark, tmp_dir):
    p = _write(os.path.join(tmp_dir, "types.csv"), "seat,flag,x,big\n12D,True,1e3,9999999999999999999\n3F,False,.5,1\nNA,NA,-2.,2\n")
    df = C.read_table(spark, p, sep=",")
    assert dict(df.dtypes) == {"seat": "string", "flag": "boolean", "x": "double", "big": "double"}
    assert {r.seat for r in df.collect()} == {"12D", "3F", None} and {r.x for r in df.collect()} == {1000.0, 0.5, -2.0}

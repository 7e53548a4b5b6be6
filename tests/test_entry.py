import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_entry_runs(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 1 and rows[0].n_test > 0


def test_catalogue_and_oracles_align():
    import __spark_entry__ as E
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 68


def test_smoke_queries_run(spark):
    import __spark_entry__ as E
    q = E.queries()
    for name in ["column_profile", "label_encode", "quantile_bins", "roc_auc", "knn_classify", "dbscan"]:
        assert q[name](spark, "/root/testdata/sf0.001").count() >= 0

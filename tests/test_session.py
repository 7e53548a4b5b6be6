import os

from tabforge import session


def test_scratch_tables_can_be_dropped(spark):
    path = session.materialize(spark.range(3)).inputFiles()[0].replace("file://", "")
    assert os.path.exists(path)
    written = list(session._WRITTEN)
    session._WRITTEN[:] = written[-1:]  # other tests may still read theirs
    assert session.drop_scratch(spark) == 1 and not os.path.exists(path)
    session._WRITTEN[:] = written[:-1]


def test_finished_tables_can_be_released(spark):
    kept, done = session.materialize(spark.range(3)), session.materialize(spark.range(4).groupBy("id").count())
    path = done.inputFiles()[0].replace("file://", "")
    session.release(done, spark.range(1))
    assert not os.path.exists(path) and kept.count() == 3
    session.release(done)

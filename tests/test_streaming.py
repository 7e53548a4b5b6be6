import os

from pyspark.sql import functions as F

from tabforge.functions import scalar as S
from tabforge.streaming import apply_to_stream


def test_prep_expressions_on_a_stream(spark, tmp_dir):
    src = os.path.join(tmp_dir, "stream-src")
    batch = spark.createDataFrame([(1, "6-2", "2024-01-05"), (2, "x", "13/02/2024")],
                                  "k long, height string, d string")
    batch.write.mode("overwrite").parquet(src)
    stream = spark.readStream.schema(batch.schema).parquet(src)

    def prep(df):
        return df.select("k", S.height_cm("height").alias("height_cm"), *S.date_parts("d", "d")[:2])

    out = apply_to_stream(stream, prep)
    q = out.writeStream.format("memory").queryName("tf_stream_out").outputMode("append").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    rows = {r.k: r for r in spark.sql("select * from tf_stream_out").collect()}
    assert abs(rows[1].height_cm - 187.96) < 1e-9 and rows[2].height_cm is None
    assert rows[2].d_month == 2
    assert F is not None

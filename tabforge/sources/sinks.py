"""Sinks (S6-S8): model, chart data and run records.

Paths are folders on shared storage; nothing is written on the driver only.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession


def save_model(model, path: str) -> str:
    """Save a fitted ``PipelineModel`` (encoders, scaler and estimator together)."""
    model.write().overwrite().save(path)
    return path


def write_chart_data(df: DataFrame, path: str, fmt: str = "parquet") -> str:
    """The data behind a chart, written as parquet (default) or CSV."""
    w = df.write.mode("overwrite")
    (w.option("header", True).csv(path) if fmt == "csv" else w.parquet(path))
    return path


def write_csv(df: DataFrame, path: str, sep: str = ",") -> str:
    """Write a table as CSV with a header (used to round-trip the CSV reader)."""
    df.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)
    return path


RUN_SCHEMA = ("model string, status string, training_time double, n_rows long, n_train long, "
              "n_test long, metric string, value double, recorded_at timestamp")


def run_report(spark: SparkSession, model: str, status: str, training_time: float, n_rows: int,
               n_train: int, n_test: int, metrics: dict[str, float]) -> DataFrame:
    """One row per metric of a model run."""
    now = _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
    rows = [(model, status, float(training_time), int(n_rows), int(n_train), int(n_test), k,
             float(v) if v is not None else None, now) for k, v in (metrics or {"none": None}).items()]
    return spark.createDataFrame(rows, RUN_SCHEMA)


def append_run_report(report: DataFrame, path: str) -> str:
    """Append the run record to a parquet folder."""
    report.write.mode("append").parquet(path)
    return path

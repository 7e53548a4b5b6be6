"""Row and value cleaning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.operators.ordinal import exact_quantiles

# Fixed value: text used for a missing category.
UNKNOWN = "未知"


def validate_selection(df: DataFrame, x: Sequence[str], y: str) -> None:
    """target must exist, X must be non-empty, y must not be in X."""
    if y not in df.columns:
        raise ValueError(f"target column {y!r} not found")
    if not x:
        raise ValueError("no feature columns selected")
    missing = [c for c in x if c not in df.columns]
    if missing:
        raise ValueError(f"feature columns not found: {missing}")
    if y in x:
        raise ValueError(f"target {y!r} is also a feature")


def drop_incomplete(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """drop rows with a NULL (or NaN) in any of ``cols``."""
    return df.dropna(how="any", subset=list(cols) if cols is not None else None)


def fill_unknown(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """missing text becomes the 'unknown' category."""
    return df.fillna({c: UNKNOWN for c in cols}) if cols else df


def impute_mean(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Replace NULL by the column mean. The mean is one scalar aggregate
    (partial sums per task, one value to the driver) applied as a literal."""
    out = out or col
    mean = df.agg(F.avg(F.col(col))).first()[0]
    return df.withColumn(out, F.coalesce(F.col(col), F.lit(mean).cast("double")))


def iqr_bounds(df: DataFrame, col: str) -> tuple[float, float]:
    """Q1 - 1.5 IQR and Q3 + 1.5 IQR with linear quantiles (exact, distributed)."""
    q1, q3 = exact_quantiles(df, col, [0.25, 0.75])
    iqr = q3 - q1
    return q1 - 1.5 * iqr, q3 + 1.5 * iqr


def iqr_filter(df: DataFrame, col: str) -> DataFrame:
    """keep rows whose ``col`` lies within the IQR fences (opt-in)."""
    lo, hi = iqr_bounds(df, col)
    return df.where(F.col(col).between(F.lit(lo), F.lit(hi)))

"""Categorical encoders.

* Label encoding: codes 0..k-1 in code-point order of the distinct values. The
  dictionary is built distributed (``ordinal.dense_codes``) and, for a reusable
  fit, written to the shared checkpoint folder; rows get their code with an
  equi-join (the planner broadcasts it only when its measured size is small;
  AQE splits a hot value's partition).
* One-hot: one 0/1 column per known value (the value list is bounded: the rule
  only one-hot encodes columns with fewer than 10 distinct values).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.session import materialize

from tabforge.operators.ordinal import dense_codes

ONE_HOT_MAX_DISTINCT = 10  # fixed value: fewer distinct values -> one-hot


def fit_label_codes(df: DataFrame, col: str, persist: bool = True) -> DataFrame:
    """Dictionary ``(value, code)`` for ``col``. With ``persist`` the
    dictionary is written to the shared folder (it is the fitted state of the encoder,
    and is read twice: once per join)."""
    codes = dense_codes(df, col, "code").withColumnRenamed(col, "value")
    return codes.transform(materialize) if persist else codes


def apply_label_codes(df: DataFrame, col: str, codes: DataFrame, out: str | None = None) -> DataFrame:
    """Look up the code of each value (NULL -> NULL code)."""
    out = out or col
    lookup = codes.select(F.col("value").alias("_tf_v"), F.col("code").alias("_tf_code"))
    joined = df.join(lookup, df[col] == lookup["_tf_v"], "left")
    return joined.withColumn(out, F.col("_tf_code").cast("long")).drop("_tf_v", "_tf_code")


def label_encode(df: DataFrame, col: str, out: str | None = None, persist: bool = True) -> DataFrame:
    """Fit and apply a label encoder on ``col``."""
    return apply_label_codes(df, col, fit_label_codes(df, col, persist), out)


def category_values(df: DataFrame, col: str, limit: int | None = ONE_HOT_MAX_DISTINCT) -> list:
    """Sorted distinct values of a low-cardinality column. With a ``limit`` more values
    raise before the list reaches the driver."""
    found = df.select(col).where(F.col(col).isNotNull()).distinct().orderBy(col)
    vals = [r[0] for r in (found.limit(limit + 1) if limit is not None else found).collect()]
    if limit is not None and len(vals) > limit:
        raise ValueError(f"{col!r} has more than {limit} values; use label_encode")
    return vals


def one_hot_columns(col: str, values: Sequence, prefix: str | None = None):
    """``prefix_value`` indicator expressions, one per value, sorted."""
    prefix = prefix if prefix is not None else col
    return [F.coalesce((F.col(f"`{col}`") == F.lit(v)).cast("int"), F.lit(0)).alias(f"{prefix}_{v}")
            for v in values]


def one_hot(df: DataFrame, col: str, values: Sequence | None = None, prefix: str | None = None,
            drop: bool = True) -> DataFrame:
    """Replace ``col`` with 0/1 columns (no level dropped)."""
    values = list(values) if values is not None else category_values(df, col)
    keep = [F.col(f"`{c}`") for c in df.columns if not (drop and c == col)]
    return df.select(*keep, *one_hot_columns(col, values, prefix))


def split_values(df: DataFrame, col: str, sep: str = ",", fill: str = "未知",
                 max_values: int | None = None) -> list[list]:
    """The values of each part of a text column split on ``sep`` (one profile job gives
    the number of parts). Each value becomes a column, so the lists are as long as the
    result is wide; a caller who wants a limit passes ``max_values`` (more raises)."""
    arr = F.split(F.col(f"`{col}`"), sep)
    n_parts = df.agg(F.max(F.size(arr))).first()[0] or 0
    parts = df.select(*[F.coalesce(F.get(arr, i), F.lit(fill)).alias(f"p{i}") for i in range(n_parts)])
    return [category_values(parts, f"p{i}", max_values) for i in range(n_parts)]


def split_one_hot(df: DataFrame, col: str, sep: str = ",", fill: str = "未知",
                  max_values: int | None = None, values: list[list] | None = None) -> DataFrame:
    """Split ``col`` on ``sep`` and one-hot each part as
    ``{col}_part{i}_{value}``; absent parts count as ``fill``."""
    values = values if values is not None else split_values(df, col, sep, fill, max_values)
    arr = F.split(F.col(f"`{col}`"), sep)
    out = df.withColumns({f"_tf_p{i}": F.coalesce(F.get(arr, i), F.lit(fill)) for i in range(len(values))})
    exprs = [e for i, v in enumerate(values) for e in one_hot_columns(f"_tf_p{i}", v, f"{col}_part{i}")]
    keep = [F.col(f"`{c}`") for c in df.columns if c != col]
    return out.select(*keep, *exprs)

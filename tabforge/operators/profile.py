"""Profiles (P1-P9) and plain aggregates.

Every profile is ONE aggregate over all wanted columns, then a tiny unpivot;
nothing is computed column by column and nothing but the small summary reaches
the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def numeric_columns(df: DataFrame) -> list[str]:
    """numeric columns (the scalers' scope)."""
    return [n for n, t in df.dtypes if is_numeric(t)]


def is_numeric(dtype: str) -> bool:
    return dtype in NUMERIC or dtype.startswith("decimal")


def text_columns(df: DataFrame) -> list[str]:
    """text columns (the encoders' scope)."""
    return [n for n, t in df.dtypes if t == "string"]


def _unpivot_rows(stats: DataFrame, items: list[tuple[str, list[tuple[str, Column]]]]) -> DataFrame:
    structs = [F.struct(F.lit(name).alias("column_name"), F.lit(pos).alias("position"),
                        *[expr.alias(alias) for alias, expr in fields])
               for pos, (name, fields) in enumerate(items)]
    return stats.select(F.explode(F.array(*structs)).alias("s")).select("s.*")


def column_profile(df: DataFrame) -> DataFrame:
    """``column_name, position, data_type, non_null`` for every column."""
    cols = df.columns
    stats = df.agg(*[F.count(_q(c)).alias(f"nn{i}") for i, c in enumerate(cols)])
    types = dict(df.dtypes)
    return _unpivot_rows(stats, [(c, [("data_type", F.lit(types[c])),
                                      ("non_null", F.col(f"nn{i}").cast("long"))])
                                 for i, c in enumerate(cols)])


def preview(df: DataFrame, order_by: Sequence[str], n: int = 5) -> DataFrame:
    """The first ``n`` rows in an explicit order (TakeOrderedAndProject)."""
    return df.orderBy(*order_by).limit(n)


def display_width(df: DataFrame, order_by: Sequence[str], n: int = 5, char_px: int = 8) -> DataFrame:
    """Column width of the preview: longest text among the first ``n`` rows and
    the header, times ``char_px``."""
    head = preview(df, order_by, n)
    cols = df.columns
    stats = head.agg(*[F.max(F.length(_q(c).cast("string"))).alias(f"w{i}")
                       for i, c in enumerate(cols)])
    return _unpivot_rows(stats, [
        (c, [("width", (F.greatest(F.coalesce(F.col(f"w{i}"), F.lit(0)), F.lit(len(c)))
                        * char_px).cast("long"))])
        for i, c in enumerate(cols)])


def numeric_stats(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """``column_name, position, min_value, max_value, mean_value, n`` per numeric column."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    aggs = []
    for i, c in enumerate(cols):
        x = _q(c).cast("double")
        aggs += [F.min(x).alias(f"mn{i}"), F.max(x).alias(f"mx{i}"),
                 F.avg(x).alias(f"av{i}"), F.count(x).alias(f"n{i}")]
    stats = df.agg(*aggs)
    return _unpivot_rows(stats, [(c, [("min_value", F.col(f"mn{i}")), ("max_value", F.col(f"mx{i}")),
                                      ("mean_value", F.col(f"av{i}")),
                                      ("n", F.col(f"n{i}").cast("long"))])
                                 for i, c in enumerate(cols)])


def missing_report(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """P5: rows, rows with any NULL/NaN in ``cols``, rows kept, percentage removed
    (0 for an empty input instead of a division by zero)."""
    cols = list(cols) if cols is not None else df.columns
    bad = F.lit(False)
    types = dict(df.dtypes)
    for c in cols:
        cond = _q(c).isNull()
        if types[c] in ("double", "float"):
            cond = cond | F.isnan(_q(c))
        bad = bad | cond
    stats = df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(bad).alias("n_incomplete"))
    return stats.select(
        F.col("n_rows").cast("long").alias("n_rows"),
        F.col("n_incomplete").cast("long").alias("n_incomplete"),
        (F.col("n_rows") - F.col("n_incomplete")).cast("long").alias("n_complete"),
        F.when(F.col("n_rows") > 0, F.col("n_incomplete") * 100.0 / F.col("n_rows"))
        .otherwise(F.lit(0.0)).alias("pct_removed"))


def distinct_counts(df: DataFrame, cols: Sequence[str], approx: bool = False) -> dict[str, int]:
    """Distinct non-null values per column in one job (exact by default: the
    encoder rule's cut-off at 10 needs the exact number)."""
    if not cols:
        return {}
    f = F.approx_count_distinct if approx else F.count_distinct
    r = df.agg(*[f(_q(c)).alias(f"d{i}") for i, c in enumerate(cols)]).first()
    return {c: int(r[f"d{i}"]) for i, c in enumerate(cols)}


def target_profile(df: DataFrame, y: str) -> DataFrame:
    """``n, n_distinct, min_value, max_value`` of the target."""
    x = _q(y)
    return df.agg(F.count(x).cast("long").alias("n"),
                  F.count_distinct(x).cast("long").alias("n_distinct"),
                  F.min(x).cast("double").alias("min_value"),
                  F.max(x).cast("double").alias("max_value"))


def value_frequency(df: DataFrame, y: str) -> DataFrame:
    """A3: ``value, n`` (the intent of the reference's bincount table)."""
    return df.groupBy(_q(y).alias("value")).agg(F.count(F.lit(1)).cast("long").alias("n"))


def distinct_values(df: DataFrame, y: str) -> DataFrame:
    """A2: distinct values of a column."""
    return df.select(_q(y).alias("value")).distinct()


def continuity(df: DataFrame, cols: Sequence[str], min_distinct: int = 10,
               min_range: float = 1.0) -> DataFrame:
    """Is a target continuous: numeric AND more than 10 distinct AND range > 1.
    One aggregate for all candidate columns."""
    types = dict(df.dtypes)
    aggs = []
    for i, c in enumerate(cols):
        x = _q(c)
        aggs += [F.count_distinct(x).alias(f"d{i}")]
        if is_numeric(types[c]):
            aggs += [(F.max(x).cast("double") - F.min(x).cast("double")).alias(f"r{i}")]
        else:
            aggs += [F.lit(None).cast("double").alias(f"r{i}")]
    stats = df.agg(*aggs)
    items = []
    for i, c in enumerate(cols):
        numeric = is_numeric(types[c])
        cont = (F.lit(numeric) & (F.col(f"d{i}") > min_distinct)
                & F.coalesce(F.col(f"r{i}") > min_range, F.lit(False)))
        items.append((c, [("n_distinct", F.col(f"d{i}").cast("long")),
                          ("value_range", F.col(f"r{i}")),
                          ("is_continuous", cont)]))
    return _unpivot_rows(stats, items)


def label_union(a: DataFrame, a_col: str, b: DataFrame, b_col: str) -> DataFrame:
    """Union of two label sets."""
    return a.select(F.col(a_col).alias("label")).union(b.select(F.col(b_col).alias("label"))).distinct()


def cluster_counts(df: DataFrame, label: str = "cluster", noise: int = -1) -> DataFrame:
    """Clusters (noise excluded) and noise points."""
    x = F.col(label)
    return df.agg(F.count_distinct(F.when(x != noise, x)).cast("long").alias("n_clusters"),
                  F.count_if(x == noise).cast("long").alias("n_noise"))


def row_index(df: DataFrame, key: str, name: str = "index") -> DataFrame:
    """0-based row position by ``key`` (distributed; see ordinal.row_positions)."""
    from tabforge.operators.ordinal import row_positions
    return row_positions(df, [key], name)


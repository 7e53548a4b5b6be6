"""Scalers and discretizers.

Statistics for all columns come from ONE aggregate (partial per task, a single
row to the driver) and are applied as literals, so scaling stays a narrow,
codegen'd projection. The built-in ``ml`` scalers differ from the wanted
semantics (MinMaxScaler maps a constant column to 0.5, StandardScaler uses the
sample deviation), hence plain column arithmetic.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabforge.operators.ordinal import exact_quantiles

BIN_PROBS = (0.2, 0.4, 0.6, 0.8)  # fixed value: 5 quantile bins


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def scaler_stats(df: DataFrame, cols: Sequence[str]) -> dict[str, dict[str, float]]:
    """min, max, mean and population std of every column, one job."""
    aggs = []
    for i, c in enumerate(cols):
        x = _q(c).cast("double")
        aggs += [F.min(x).alias(f"mn{i}"), F.max(x).alias(f"mx{i}"),
                 F.avg(x).alias(f"av{i}"), F.stddev_pop(x).alias(f"sd{i}")]
    r = df.agg(*aggs).first() if aggs else None
    return {c: {"min": r[f"mn{i}"], "max": r[f"mx{i}"], "mean": r[f"av{i}"], "std": r[f"sd{i}"]}
            for i, c in enumerate(cols)}


def minmax_exprs(cols: Sequence[str], stats, suffix: str = "") -> list[Column]:
    """T5: ``(x - min) / (max - min)``; a constant column becomes 0."""
    out = []
    for c in cols:
        lo, hi = stats[c]["min"], stats[c]["max"]
        span = (hi - lo) if lo is not None and hi is not None else None
        x = _q(c).cast("double")
        e = (x - F.lit(lo)) / F.lit(span) if span else x * 0.0
        out.append(e.alias(c + suffix))
    return out


def standard_exprs(cols: Sequence[str], stats, suffix: str = "") -> list[Column]:
    """``(x - mean) / std_pop``; a constant column becomes 0."""
    out = []
    for c in cols:
        mu, sd = stats[c]["mean"], stats[c]["std"]
        x = _q(c).cast("double")
        e = (x - F.lit(mu)) / F.lit(sd) if sd else x * 0.0
        out.append(e.alias(c + suffix))
    return out


def minmax_scale(df: DataFrame, cols: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    """T5 on ``cols``; statistics from ``fit_on`` (train rows) or ``df``."""
    stats = scaler_stats(fit_on if fit_on is not None else df, cols)
    ex = dict(zip(cols, minmax_exprs(cols, stats)))
    return df.select(*[ex.get(c, _q(c)) for c in df.columns])


def standard_scale(df: DataFrame, cols: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    """T6 on ``cols``; statistics from ``fit_on`` (train rows) or ``df``."""
    stats = scaler_stats(fit_on if fit_on is not None else df, cols)
    ex = dict(zip(cols, standard_exprs(cols, stats)))
    return df.select(*[ex.get(c, _q(c)) for c in df.columns])


def apply_standard(df: DataFrame, cols: Sequence[str], stats) -> DataFrame:
    """T6 with statistics fitted before."""
    ex = dict(zip(cols, standard_exprs(cols, stats)))
    return df.select(*[ex.get(c, _q(c)) for c in df.columns])


def quantile_edges(df: DataFrame, col: str, probs: Sequence[float] = BIN_PROBS) -> list[float]:
    """Inner bin edges = linear quantiles, duplicates removed (exact, distributed)."""
    edges = [e for e in exact_quantiles(df, col, probs) if e is not None]
    return sorted(set(edges))


def bin_expr(col: str | Column, edges: Sequence[float]) -> Column:
    """Ordinal bin = number of edges <= value (a value on an edge goes up)."""
    x = F.col(col) if isinstance(col, str) else col
    if not edges:
        return F.lit(0).cast("long")
    s = sum((F.when(x >= F.lit(e), 1).otherwise(0) for e in edges), F.lit(0))
    return F.when(x.isNull(), None).otherwise(s).cast("long")


def quantile_bins(df: DataFrame, col: str, out: str = "bin",
                  probs: Sequence[float] = BIN_PROBS) -> DataFrame:
    """5 ordinal quantile bins of a continuous target."""
    return df.withColumn(out, bin_expr(col, quantile_edges(df, col, probs)))


def polynomial_columns(cols: Sequence[str], degree: int, prefix: str = "poly") -> list[Column]:
    """The monomials of ``PolynomialExpansion`` in its order, as named columns
    (no bias term). Use ``ml.feature.PolynomialExpansion`` inside pipelines."""
    terms: list[tuple[int, ...]] = []

    def expand(k: int, d: int) -> list[tuple[int, ...]]:
        # exponents for the first k features, total degree <= d, in Spark's order
        if k == 0:
            return [()]
        res = []
        for e in range(d + 1):
            for rest in expand(k - 1, d - e):
                res.append(rest + (e,))
        return res
    terms = [t for t in expand(len(cols), degree) if sum(t) > 0]
    out = []
    for i, t in enumerate(terms):
        e = F.lit(1.0)
        for c, p in zip(cols, t):
            for _ in range(p):
                e = e * _q(c).cast("double")
        out.append(e.alias(f"{prefix}_{i}"))
    return out

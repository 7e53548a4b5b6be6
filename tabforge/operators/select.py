"""Feature selection (T8, O3) and PCA variance (T9), both opt-in as in the reference.

Mutual information is estimated from equal-width bins: one min/max aggregate,
then ONE grouped count over ``(feature, x_bin, y_bin)`` (partial per task, at
most features x bins^2 rows after the shuffle), and the sum of
``p ln(p / (px py))`` over that small table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import PCA
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabforge.operators.models import assemble

PCA_VARIANCE = 0.95  # fixed value: keep components up to 95 % of the variance
TOP_K = 10           # fixed value: number of features kept


def _bin(col: str, lo: float, hi: float, bins: int):
    """Equal-width bin 0..bins-1; NULL and NaN share a bin of their own (``bins``)."""
    x = F.col(col).cast("double")
    missing = x.isNull() | F.isnan(x)
    if lo is None or hi is None or hi <= lo:
        return F.when(missing, F.lit(bins)).otherwise(F.lit(0)).cast("long")
    return (F.when(missing, F.lit(bins))
            .otherwise(F.least(F.floor((x - F.lit(lo)) / F.lit(hi - lo) * bins), F.lit(bins - 1))).cast("long"))


def mutual_information(df: DataFrame, features: Sequence[str], target: str, bins: int = 10) -> DataFrame:
    """``feature, mi`` (nats) between each binned feature and the binned target."""
    cols = list(features) + [target]
    known = [F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in cols]
    r = df.agg(*[F.min(x).alias(f"mn{i}") for i, x in enumerate(known)],
               *[F.max(x).alias(f"mx{i}") for i, x in enumerate(known)]).first()
    yb = _bin(target, r[f"mn{len(features)}"], r[f"mx{len(features)}"], bins)
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"),
                               _bin(f, r[f"mn{i}"], r[f"mx{i}"], bins).alias("bx"))
                      for i, f in enumerate(features)])
    long = df.select(yb.alias("by"), F.explode(pairs).alias("p")).select("p.feature", "p.bx", "by")
    counts = long.groupBy("feature", "bx", "by").agg(F.count(F.lit(1)).alias("c"))
    n = F.sum("c").over(Window.partitionBy("feature"))
    px = F.sum("c").over(Window.partitionBy("feature", "bx"))
    py = F.sum("c").over(Window.partitionBy("feature", "by"))
    term = (F.col("c") / n) * F.log((F.col("c") * n) / (px * py))
    return counts.select("feature", term.alias("t")).groupBy("feature").agg(F.sum("t").alias("mi"))


def top_k(scores: DataFrame, k: int = TOP_K, score: str = "mi") -> DataFrame:
    """O3: the k best features (ties by name); the limit is the feature."""
    return scores.orderBy(F.desc(score), "feature").limit(k)


def pca_variance(df: DataFrame, features: Sequence[str], keep: float = PCA_VARIANCE) -> DataFrame:
    """Explained-variance ratio per component and whether it is kept (the
    first components whose cumulative ratio reaches ``keep``). The covariance is
    a d x d aggregate over all rows inside Spark ML."""
    data = assemble(df, features)
    model = PCA(k=len(features), inputCol="features", outputCol="pca").fit(data)
    ratios = [float(x) for x in model.explainedVariance.toArray()]
    rows, cum, reached = [], 0.0, False
    for i, r in enumerate(ratios):
        cum += r
        rows.append((i, r, cum, not reached))
        reached = reached or cum >= keep
    return df.sparkSession.createDataFrame(
        rows, "component int, explained_ratio double, cumulative double, kept boolean")

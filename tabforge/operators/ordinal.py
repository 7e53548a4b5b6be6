"""Order-dependent numbering without a single-partition window.

``Window.orderBy(...)`` with no ``partitionBy`` moves every row into one task. Here

1. split points are read once, as literals, from a bounded sample of the order keys
   (they decide how even the buckets are, never the result),
2. each row's bucket is its place among those literals - a pure function of the row,
   so every branch of a plan gives a row the same bucket, whatever the optimizer does,
3. a window inside (bucket, groups) gives the local running sum; the totals of the
   buckets (at most ``buckets x groups`` rows) become offsets, joined back.

Used for label codes (dense rank of distinct values), row positions, exact
quantiles, ROC cumulative counts and global row numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BUCKET = "_tf_bucket"
#: Sampled keys per bucket, and the most keys that reach the driver.
SAMPLE_PER_BUCKET, SAMPLE_MAX = 40, 20_000

Order = str | tuple[str, bool]


def _keys(order: Sequence[Order]) -> list[tuple[str, bool]]:
    return [(o, True) if isinstance(o, str) else o for o in order]


def _sort(order: Sequence[Order]) -> list[Column]:
    return [F.col(c).asc_nulls_first() if up else F.col(c).desc_nulls_last() for c, up in _keys(order)]


def split_points(df: DataFrame, order: Sequence[Order], n: int) -> list[tuple]:
    """At most ``n - 1`` distinct key tuples, ascending in ``order``, from a bounded sample."""
    names = [c for c, _ in _keys(order)]
    if n <= 1:
        return []
    want = min(SAMPLE_MAX, n * SAMPLE_PER_BUCKET)
    keys = df.select(*names)
    total = keys.count()
    if total > want:
        keys = keys.sample(fraction=min(1.0, 1.3 * want / total), seed=11)
    rows = [tuple(r) for r in keys.limit(2 * want).orderBy(*_sort(order)).collect()]
    if not rows:
        return []
    picked = [rows[len(rows) * i // n] for i in range(1, n)]
    return [p for i, p in enumerate(picked) if not i or p != picked[i - 1]]


def _before(order: Sequence[Order], point: tuple) -> Column:
    """Is the row's key strictly before ``point``? Never NULL."""
    out = F.lit(False)
    for (name, up), v in reversed(list(zip(_keys(order), point))):
        c = F.col(name)
        if v is None:
            less = F.lit(False) if up else c.isNotNull()
        else:
            less = F.coalesce((c < F.lit(v)) if up else (c > F.lit(v)), F.lit(up))
        out = less | (c.eqNullSafe(F.lit(v)) & out)
    return out


def bucket_of(order: Sequence[Order], points: list[tuple]) -> Column:
    """Number of split points at or before the row's key: a binary search written as
    nested CASEs, so a row costs log2(n) comparisons."""
    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(_before(order, points[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))
    return tree(0, len(points))


def _partitions(df: DataFrame, num_partitions: int | None) -> int:
    return num_partitions or max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)


def ordered_cumsum(df: DataFrame, order: Sequence[Order], values: dict[str, str],
                   group_cols: Sequence[str] = (), num_partitions: int | None = None) -> DataFrame:
    """Inclusive running sums of ``values`` (out_name -> input column) in ``order``,
    restarting for each combination of ``group_cols``.

    ``order`` lists column names, or (name, ascending) pairs; ties must be broken by
    the caller if the result has to be deterministic. NULL values count as 0."""
    group_cols = list(group_cols)
    points = split_points(df, order, _partitions(df, num_partitions))
    rows = df.withColumn(_BUCKET, bucket_of(order, points))
    w = (Window.partitionBy(_BUCKET, *group_cols).orderBy(*_sort(order))
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = rows.withColumns({f"_tf_local_{k}": F.sum(F.coalesce(F.col(src), F.lit(0))).over(w)
                              for k, src in values.items()})
    totals = rows.groupBy(_BUCKET, *group_cols).agg(
        *[F.sum(F.coalesce(F.col(src), F.lit(0))).alias(f"_tf_tot_{k}") for k, src in values.items()])
    # at most buckets x groups rows
    up_to = (Window.partitionBy(*group_cols) if group_cols else Window.partitionBy()).orderBy(_BUCKET)
    up_to = up_to.rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(_BUCKET, *[F.col(g).alias(f"_tf_g{i}") for i, g in enumerate(group_cols)],
                            *[F.coalesce(F.sum(f"_tf_tot_{k}").over(up_to), F.lit(0)).alias(f"_tf_off_{k}")
                              for k in values]).withColumnRenamed(_BUCKET, "_tf_b")
    on = F.col(_BUCKET) == F.col("_tf_b")
    for i, g in enumerate(group_cols):
        on = on & F.col(g).eqNullSafe(F.col(f"_tf_g{i}"))
    # without groups the offsets have one row per bucket: a proven bound for the broadcast
    joined = local.join(offsets if group_cols else F.broadcast(offsets), on, "left")
    return joined.select(*df.columns, *[(F.col(f"_tf_local_{k}") + _offset(k)).alias(k) for k in values])


def _offset(k: str) -> Column:
    return F.coalesce(F.col(f"_tf_off_{k}"), F.raise_error(F.lit("ordinal: a bucket has no total")).cast("long"))


def row_positions(df: DataFrame, order: Sequence[Order], name: str = "index",
                  num_partitions: int | None = None) -> DataFrame:
    """0-based position of each row in ``order`` (a distributed ``row_number() - 1``).
    Rows that tie on the whole ``order`` get different positions in any order."""
    points = split_points(df, order, _partitions(df, num_partitions))
    rows = df.withColumn(_BUCKET, bucket_of(order, points))
    sizes = rows.groupBy(_BUCKET).agg(F.count(F.lit(1)).alias("_tf_n"))
    up_to = Window.partitionBy().orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col(_BUCKET).alias("_tf_b"),
                           F.coalesce(F.sum("_tf_n").over(up_to), F.lit(0)).alias("_tf_off_rn"))
    rn = F.row_number().over(Window.partitionBy(_BUCKET).orderBy(*_sort(order)))
    return (rows.withColumn("_tf_rn", rn)
            .join(F.broadcast(offsets), F.col(_BUCKET) == F.col("_tf_b"), "left")
            .select(*df.columns, (F.col("_tf_rn") - 1 + _offset("rn")).cast("long").alias(name)))


def dense_codes(values: DataFrame, value_col: str, code_col: str = "code",
                num_partitions: int | None = None) -> DataFrame:
    """Codes 0..k-1 for the distinct values of ``value_col`` in code-point order
    (what a label encoder fits). Output: (value_col, code_col)."""
    distinct = values.select(value_col).where(F.col(value_col).isNotNull()).distinct()
    return row_positions(distinct, [value_col], code_col, num_partitions)


def exact_quantiles(df: DataFrame, col: str, probs: Sequence[float]) -> list[float | None]:
    """Linear-interpolated quantiles (pandas / ``quantile_cont``), exact, without
    shuffling the column: approximate percentiles give a bracket around each wanted
    rank, one aggregate counts the rows below each bracket, and only a bracket's own
    values are counted by value. A bracket that turns out not to hold its rank (the
    sketch's error is not a hard bound) is widened to the whole column."""
    base = df.select(F.col(col).cast("double").alias("_q_v")).where(
        F.col("_q_v").isNotNull() & ~F.isnan("_q_v"))
    err = 1e-3
    marks = sorted({min(1.0, max(0.0, p + s * 2 * err)) for p in probs for s in (-1, 1)})
    head = base.agg(F.count(F.lit(1)).alias("n"), F.min("_q_v").alias("lo"), F.max("_q_v").alias("hi"),
                    F.percentile_approx("_q_v", marks, int(1 / err)).alias("q")).first()
    n = head["n"]
    if not n:
        return [None for _ in probs]
    at = dict(zip(marks, head["q"]))
    spots, brackets = [], []
    for p in probs:
        h = (n - 1) * float(p)
        lo = int(h // 1)
        hi = min(lo + 1, n - 1)
        spots.append((h, lo, hi))
        brackets.append((head["lo"] if p - 2 * err <= 0 else at[p - 2 * err],
                         head["hi"] if p + 2 * err >= 1 else at[p + 2 * err]))
    below = base.agg(*[F.count_if(F.col("_q_v") < F.lit(a)).alias(f"b{i}") for i, (a, _) in enumerate(brackets)],
                     *[F.count_if(F.col("_q_v") <= F.lit(b)).alias(f"e{i}") for i, (_, b) in enumerate(brackets)]).first()
    out = []
    for i, ((h, lo, hi), (a, b)) in enumerate(zip(spots, brackets)):
        start = below[f"b{i}"]
        if not (start <= lo and hi < below[f"e{i}"]):
            a, b, start = head["lo"], head["hi"], 0
        counts = (base.where((F.col("_q_v") >= F.lit(a)) & (F.col("_q_v") <= F.lit(b)))
                  .groupBy("_q_v").agg(F.count(F.lit(1)).alias("_q_n")))
        cum = ordered_cumsum(counts, ["_q_v"], {"_q_cum": "_q_n"})
        want = sorted({lo, hi})
        rows = cum.where(" OR ".join(f"(_q_cum - _q_n <= {r - start} AND _q_cum > {r - start})" for r in want)).collect()
        value = {r: x["_q_v"] for r in want for x in rows if x["_q_cum"] - x["_q_n"] <= r - start < x["_q_cum"]}
        out.append(value[lo] + (h - lo) * (value[hi] - value[lo]))
    return out

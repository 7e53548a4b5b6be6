"""Exact k-nearest neighbours (M6, W4, J4) and the k-value curve (V9).

Spark has no neighbour join, and candidate pairs as rows would be sorted and spilled in
proportion to the product of queries and training rows. The search here is exact and blocked:

1. training rows are numbered in the order that breaks ties (their id); of equal vectors only
   the first k can be among any k nearest. Equal query vectors are searched once;
2. queries and training rows are dealt to blocks, and each pair of blocks is one task: matrix
   products bound all its distances, and what may be among a query's k nearest is computed
   again term by term, so distances and ties are those of the plain sum of squares;
3. k rows a query and training block leave a task; a window keeps the k best (a
   WindowGroupLimit).

Work is the product of queries and training rows (exact search has no less in many
dimensions); rows moved are ``queries x training blocks + training rows x query blocks``, and
a task holds one block of each.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabforge.operators.ordinal import row_positions
from tabforge.session import materialize

SALT_ROWS = 65_536  # training rows of a block
QUERY_ROWS = 16_384  # queries of a block
PAIRS_AT_ONCE = 1 << 22  # distances that a task holds at once


def centroid(df: DataFrame, vec: str) -> list[float]:
    """Per-dimension mean: one vector aggregate, d values reach the driver."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer
    m = df.select(Summarizer.mean(array_to_vector(F.col(vec).cast("array<double>"))).alias("m")).first()["m"]
    return [float(x) for x in m.toArray()]


def block_nearest(q: np.ndarray, t: np.ndarray, r: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in ``q``, number, distance) of the k rows of ``t`` (numbers ``r``) nearest to each
    row of ``q``, ties to the smaller number. Products only rule rows out: their error is
    bounded, and distances of what remains are summed term by term."""
    k = min(k, len(t))
    middle = t.mean(axis=0)
    tc = t - middle
    tt = (tc * tc).sum(axis=1)
    step = max(1, PAIRS_AT_ONCE // len(t))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, len(q), step):
        qc = q[at:at + step] - middle
        qq = (qc * qc).sum(axis=1)
        near = (qq[:, None] + tt) - 2 * (qc @ tc.T)
        slack = 16 * (t.shape[1] + 4) * np.finfo(float).eps * (qq + tt.max())
        bound = np.partition(near, k - 1, axis=1)[:, k - 1] + slack
        row, col = np.nonzero(~(near > bound[:, None]))
        x = np.zeros(len(row))
        for i in range(t.shape[1]):  # one dimension at a time: the order of the plain sum
            d = q[at + row, i] - t[col, i]
            x += d * d
        x = np.sqrt(x)
        order = np.lexsort((r[col], x, row))
        row, col, x = row[order], col[order], x[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        best = place < k
        out.append((at + row[best], r[col[best]], x[best]))
    return tuple(np.concatenate(c) for c in zip(*out))


def _search(queries: DataFrame, train: DataFrame, k: int, q_blocks: int, t_blocks: int) -> DataFrame:
    """(u, r, dist): the k nearest training rows (r, v) of every query (u, v)."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = queries.withColumn("i", deal("u", q_blocks)).withColumn("j", every(t_blocks))
    right = train.withColumn("j", deal("r", t_blocks)).withColumn("i", every(q_blocks))

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"u": [], "r": [], "dist": []}).astype({"u": "int64", "r": "int64", "dist": "float64"})
        place, r, dist = block_nearest(np.stack(a["v"].to_numpy()), np.stack(b["v"].to_numpy()), b["r"].to_numpy(), k)
        return pd.DataFrame({"u": a["u"].to_numpy()[place], "r": r, "dist": dist})

    found = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(best, "u long, r long, dist double")
    w = Window.partitionBy("u").orderBy("dist", "r")
    return found.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).drop("n")


def knn(train: DataFrame, query: DataFrame, k: int, id_col: str = "id", vec: str = "vec",
        label: str = "label", rings: int | None = None) -> DataFrame:
    """Exact k nearest training rows of every query row.

    ``train``: (id_col, vec, label); ``query``: (id_col, vec). Output:
    ``q_id, t_id, t_label, dist, rank`` with rank 1..k (ties by training id).
    ``rings``: at least so many blocks of training rows (more tasks of fewer rows). Rows
    without a whole vector, and queries without an id, take no part."""
    spark = train.sparkSession
    d = len(centroid(train, vec))
    whole = F.col("v").isNotNull() & (F.size("v") == d) & ~F.exists("v", lambda x: x.isNull())
    v = F.col(vec).cast("array<double>").alias("v")
    t = train.select(F.col(id_col).alias("t_id"), v, F.col(label).alias("t_label")).where(whole)
    copy = F.row_number().over(Window.partitionBy("v").orderBy("t_id", "t_label"))
    t = materialize(t.withColumn("copy", copy).where(F.col("copy") <= k).drop("copy"), "knn-train")
    n_train = t.count()
    if n_train == 0:
        raise ValueError("empty training set")
    t = materialize(row_positions(t, ["t_id"], "r"), "knn-numbered")
    q = query.select(F.col(id_col).alias("q_id"), v).where(whole & F.col("q_id").isNotNull())
    # the numbers are written with the vectors: any will do
    points = materialize(q.select("v").distinct().withColumn("u", F.monotonically_increasing_id()), "knn-queries")
    t_blocks = max(rings or 1, math.ceil(n_train / SALT_ROWS))
    q_blocks = max(1, math.ceil(points.count() / QUERY_ROWS))
    # small tables: smaller blocks keep the cores busy
    par = int(spark.conf.get("spark.sql.shuffle.partitions"))
    q_blocks = max(q_blocks, min(math.ceil(2 * par / t_blocks), math.ceil(points.count() / 512)))
    near = materialize(_search(points, t.select("r", "v"), k, q_blocks, t_blocks), "knn-near")
    near = near.join(t.select("r", "t_id", "t_label"), "r").select("u", "t_id", "t_label", "dist")
    near = near.groupBy("u").agg(F.collect_list(F.struct("dist", "t_id", "t_label")).alias("near"))
    rows = q.join(points, "v").select("q_id", "u").join(near, "u").select("q_id", F.explode("near").alias("x"))
    # a repeated query id takes the best of all its rows
    w = Window.partitionBy("q_id").orderBy("x.dist", "x.t_id")
    return (rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("q_id", "x.t_id", "x.t_label", "x.dist", "rank").transform(materialize))


def vote(neigh: DataFrame, k: int | None = None) -> DataFrame:
    """Majority label of the first k neighbours (ties -> smallest label) and the
    vote shares (X8): ``q_id, y_pred, y_prob`` (map label -> share)."""
    nb = neigh if k is None else neigh.where(F.col("rank") <= k)
    counts = nb.groupBy("q_id", "t_label").agg(F.count(F.lit(1)).alias("c"))
    tot = F.sum("c").over(Window.partitionBy("q_id"))
    w = Window.partitionBy("q_id").orderBy(F.col("c").desc(), F.col("t_label").asc())
    ranked = counts.withColumn("share", F.col("c") / tot).withColumn("r", F.row_number().over(w))
    probs = ranked.groupBy("q_id").agg(F.map_from_entries(F.collect_list(F.struct("t_label", "share"))).alias("y_prob"))
    best = ranked.where("r = 1").select("q_id", F.col("t_label").alias("y_pred"))
    return best.join(probs, "q_id")


def regress(neigh: DataFrame) -> DataFrame:
    """Uniform-weight neighbour mean: ``q_id, y_pred``."""
    return neigh.groupBy("q_id").agg(F.avg(F.col("t_label").cast("double")).alias("y_pred"))


def k_value_curve(neigh: DataFrame, truth: DataFrame, k_max: int) -> DataFrame:
    """V9: accuracy for every k = 1..k_max from ONE neighbour search of depth
    k_max: neighbour at rank r votes in every k >= r (k_max (k_max+1)/2 rows per
    query, independent of data size). ``truth``: (q_id, y_true)."""
    ks = neigh.where(F.col("rank") <= k_max).withColumn(
        "k", F.explode(F.sequence(F.col("rank"), F.lit(k_max))))
    counts = ks.groupBy("k", "q_id", "t_label").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("k", "q_id").orderBy(F.col("c").desc(), F.col("t_label").asc())
    pred = counts.withColumn("r", F.row_number().over(w)).where("r = 1")
    scored = pred.join(truth, "q_id").withColumn("hit", (F.col("t_label") == F.col("y_true")).cast("double"))
    return scored.groupBy("k").agg(F.avg("hit").alias("accuracy"))


def k_max_for(n: int, cap: int = 30) -> int:
    """range(1, min(cap + 1, n // 2)) -> largest k."""
    return max(0, min(cap + 1, n // 2) - 1)


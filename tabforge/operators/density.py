"""DBSCAN (M11) as joins, aggregates and label propagation.

* Neighbour pairs: rows are placed in grid cells of side ``eps`` on the first
  ``g <= 3`` dimensions; a pair within ``eps`` differs by at most ``eps`` in
  every coordinate, so it lies in the same or an adjacent cell. Each row is
  exploded to its 3^g neighbouring cell keys and equi-joined on the key, then the
  full distance is checked. No cross join.
* Core rows: at least ``min_samples`` neighbours within ``eps`` (self included).
* Clusters: connected components of the core graph: tasks join their own edges by union-find,
  a bounded number at a time, then alternating large-star / small-star rounds; each round's
  edge set is checkpointed to the shared folder (lineage stays short and a lost executor
  repeats one round only).
* Numbering as the reference: clusters are numbered by their smallest core row
  id, a border row takes the lowest-numbered adjacent cluster, noise is -1.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.session import materialize

from tabforge.operators.ordinal import dense_codes

MAX_ROUNDS = 200
CHUNK = 100_000  # edges that a task joins at a time before the star rounds
EPS, MIN_SAMPLES = 0.5, 5  # fixed values: library defaults used by the reference


def neighbour_pairs(df: DataFrame, id_col: str, vec: str, eps: float, grid_dims: int = 3) -> DataFrame:
    """All (a, b) with distance(a, b) <= eps, both directions, self pairs included."""
    d = df.select(F.size(vec)).first()[0]
    g = max(1, min(grid_dims, d))
    pts = df.select(F.col(id_col).alias("id"), F.col(vec).cast("array<double>").alias("v"))
    pts = pts.withColumn("cell", F.array(*[F.floor(F.col("v")[i] / F.lit(eps)).cast("long")
                                            for i in range(g)]))
    offsets = [list(o) for o in itertools.product((-1, 0, 1), repeat=g)]
    shifted = F.array(*[F.array(*[(F.col("cell")[i] + F.lit(o[i])) for i in range(g)]) for o in offsets])
    probe = pts.select(F.col("id").alias("a"), F.col("v").alias("va"), F.explode(shifted).alias("cell"))
    base = pts.select(F.col("id").alias("b"), F.col("v").alias("vb"), "cell")
    d2 = F.aggregate(F.zip_with("va", "vb", lambda x, y: (x - y) * (x - y)), F.lit(0.0),
                     lambda acc, v: acc + v)
    return probe.join(base, "cell").where(d2 <= F.lit(eps * eps)).select("a", "b")


def _sym(e: DataFrame) -> DataFrame:
    """Both directions, no self loops, no duplicates."""
    both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.where(F.col("a") != F.col("b")).distinct()


def _large_star(e: DataFrame) -> DataFrame:
    """Every neighbour larger than u is linked to the smallest of u's closed neighbourhood."""
    m = e.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return _sym(e.where(F.col("b") > F.col("a")).join(m, "a")
                .select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(e: DataFrame) -> DataFrame:
    """u and its smaller neighbours are linked to the smallest of them."""
    le = e.where(F.col("b") < F.col("a"))
    m = le.groupBy("a").agg(F.min("b").alias("m"))
    spokes = le.join(m, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    centre = m.select("a", F.col("m").alias("b"))
    keep = e.join(m.select("a"), "a", "left_anti")  # nodes without smaller neighbours keep theirs
    return _sym(spokes.union(centre).union(keep))


def _forest(e: DataFrame) -> DataFrame:
    """Fewer edges with the same components: a task joins at most CHUNK edges at a time and hands
    on, for each node it met but the smallest of its tree, the edge (node, smallest)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for pdf in batches:
            if n and n + len(pdf) > CHUNK:
                yield joined(pd.concat(held, ignore_index=True))
                held, n = [], 0
            held.append(pdf)
            n += len(pdf)
        if n:
            yield joined(pd.concat(held, ignore_index=True))

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        codes, nodes = pd.factorize(pd.concat([pdf["a"], pdf["b"]], ignore_index=True), sort=True)
        up = list(range(len(nodes)))

        def top(x: int) -> int:
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for x, y in zip(codes[:len(pdf)].tolist(), codes[len(pdf):].tolist()):
            x, y = top(x), top(y)
            up[max(x, y)] = min(x, y)
        tops = np.array([top(x) for x in range(len(up))], dtype=np.int64)
        low = np.flatnonzero(tops != np.arange(len(up)))
        return pd.DataFrame({"a": nodes[low], "b": nodes[tops[low]]})

    kind = e.schema["a"].dataType.simpleString()
    return e.mapInPandas(run, f"a {kind}, b {kind}")


def connected_min_labels(nodes: DataFrame, edges: DataFrame, files: int | None = None) -> DataFrame:
    """(node, label = smallest node id of its component). Tasks first join their own edges
    (CHUNK at a time); what a single chunk cannot join follows by alternating large-star
    and small-star rounds (O(log^2 n) rounds). The edge set is checkpointed to the
    shared folder after every round. ``nodes``: (node); ``edges``: (a, b), first written in at
    most ``files`` files."""
    half = edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    half = half.distinct()
    half = materialize(half.coalesce(files) if files else half)
    chunks = -(-half.count() // CHUNK)
    if chunks <= 1:
        lab = _forest(half.coalesce(1))
        lab = lab.select(F.col("a").alias("node"), F.col("b").alias("m"))
        return (nodes.join(lab, "node", "left")
                .select("node", F.coalesce("m", "node").alias("label")))
    e = _sym(_forest(half.coalesce(chunks))).transform(materialize)
    n_e = e.count()
    for _ in range(MAX_ROUNDS):
        nxt = _small_star(_large_star(e)).transform(materialize)
        n_nxt = nxt.count()  # parquet footers only
        # a different edge count means a change; only equal counts need the
        # exact check (no edge on just one side of a full outer join)
        same = n_nxt == n_e and (
            nxt.withColumn("_n", F.lit(1)).join(e.withColumn("_o", F.lit(1)), ["a", "b"], "full_outer")
            .where(F.col("_n").isNull() | F.col("_o").isNull()).isEmpty())
        e, n_e = nxt, n_nxt
        if same:
            break
    else:
        raise RuntimeError("connected components did not converge")
    lab = e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
    return (nodes.join(lab, "node", "left")
            .select("node", F.least(F.col("node"), F.coalesce("m", "node")).alias("label")))


def _clique_offsets(d: int) -> list[list[int]]:
    """Offsets of the cells (side eps/sqrt(d)) that can hold a point within eps of
    a point in the centre cell, the centre excluded."""
    r = math.ceil(math.sqrt(d))
    out = []
    for o in itertools.product(range(-r, r + 1), repeat=d):
        if all(x == 0 for x in o):
            continue
        gap = sum((max(abs(x) - 1, 0)) ** 2 for x in o) / d   # in units of eps^2
        if gap <= 1.0:
            out.append(list(o))
    return out


def dbscan(df: DataFrame, id_col: str, vec: str, eps: float = EPS, min_samples: int = MIN_SAMPLES,
           grid_dims: int = 3) -> DataFrame:
    """``id_col, cluster`` (-1 = noise) and ``is_core``.

    For up to 3 dimensions the grid has cells of side eps/sqrt(d): any two points
    of one cell are within eps, so a cell is a clique and pairs INSIDE a cell are
    never formed (a cell holding a third of the rows costs nothing extra).
    Identical points are merged first (weight = multiplicity). Only pairs
    across cells are enumerated:
      * neighbour count = weight of the own cell + weights of close points of
        other cells; cells of weight >= min_samples are all core;
      * two cells are connected when a core pair across them is within eps;
        components of the cell graph give the clusters;
      * a non-core point takes the lowest cluster among its own cell's and
        its close core neighbours'.
    Higher dimensions fall back to ``dbscan_pairs`` (grid on 3 dimensions)."""
    d = df.select(F.size(vec)).first()[0]
    if d > grid_dims:
        return dbscan_pairs(df, id_col, vec, eps, min_samples, grid_dims)
    side = eps / math.sqrt(d)
    v = F.col(vec).cast("array<double>")
    # merge identical points (pre-aggregated before any pair is formed)
    pts = (df.select(F.col(id_col).alias("_id"), v.alias("v"))
           .groupBy("v").agg(F.min("_id").alias("pid"), F.count(F.lit(1)).alias("w"))
           .withColumn("cell", F.array(*[F.floor(F.col("v")[i] / F.lit(side)).cast("long") for i in range(d)]))
           .transform(materialize))
    cells = pts.groupBy("cell").agg(F.sum("w").alias("cw"))
    offs = _clique_offsets(d)
    shifted = F.array(*[F.array(*[(F.col("cell")[i] + F.lit(o[i])) for i in range(d)]) for o in offs])
    probe = pts.select(F.col("pid").alias("a"), F.col("v").alias("va"), F.col("cell").alias("ca"),
                       F.explode(shifted).alias("cell"))
    base = pts.select(F.col("pid").alias("b"), F.col("v").alias("vb"), F.col("w").alias("wb"), "cell")
    d2 = F.aggregate(F.zip_with("va", "vb", lambda x, y: (x - y) * (x - y)), F.lit(0.0),
                     lambda acc, z: acc + z)
    cross = (probe.join(base, "cell").where(d2 <= F.lit(eps * eps))
             .select("a", "b", "wb", F.col("ca"), F.col("cell").alias("cb"))).transform(materialize)
    near = cross.groupBy("a").agg(F.sum("wb").alias("nw"))
    info = (pts.join(cells, "cell").join(near.withColumnRenamed("a", "pid"), "pid", "left")
            .select("pid", "v", "cell", "w", "cw",
                    ((F.col("cw") + F.coalesce("nw", F.lit(0))) >= min_samples).alias("is_core"))
            ).transform(materialize)
    core = info.where("is_core")
    # a cell's node id: its smallest core point id
    cell_node = core.groupBy("cell").agg(F.min("pid").alias("node"))
    core_ids = core.select(F.col("pid").alias("a"))
    core_cross = (cross.join(core_ids, "a", "left_semi")
                  .join(core_ids.withColumnRenamed("a", "b"), "b", "left_semi"))
    edges = (core_cross.join(cell_node.withColumnRenamed("cell", "ca").withColumnRenamed("node", "na"), "ca")
             .join(cell_node.withColumnRenamed("cell", "cb").withColumnRenamed("node", "nb"), "cb")
             .select(F.col("na").alias("a"), F.col("nb").alias("b")).distinct())
    comp = connected_min_labels(cell_node.select("node"), edges)
    numbers = dense_codes(comp, "label", "cluster")
    cell_cluster = (cell_node.join(comp, "node").join(numbers, "label").select("cell", "cluster"))
    core_lab = core.join(cell_cluster, "cell").select("pid", "cluster", F.lit(True).alias("is_core"))
    noncore = info.where(~F.col("is_core")).select("pid", "cell")
    own = noncore.join(cell_cluster, "cell").select("pid", "cluster")
    via = (cross.join(noncore.select(F.col("pid").alias("a")), "a", "left_semi")
           .join(core_lab.select(F.col("pid").alias("b"), "cluster"), "b")
           .select(F.col("a").alias("pid"), "cluster"))
    border = own.unionByName(via).groupBy("pid").agg(F.min("cluster").alias("cluster"))
    labelled = (noncore.select("pid").join(border, "pid", "left")
                .select("pid", F.coalesce("cluster", F.lit(-1)).alias("cluster"), F.lit(False).alias("is_core"))
                .unionByName(core_lab))
    point_lab = pts.select("v", "pid").join(labelled, "pid").select("v", "cluster", "is_core")
    return (df.select(F.col(id_col), v.alias("v")).join(point_lab, "v")
            .select(id_col, F.col("cluster").cast("long"), "is_core"))


def dbscan_pairs(df: DataFrame, id_col: str, vec: str, eps: float = EPS, min_samples: int = MIN_SAMPLES,
                 grid_dims: int = 3) -> DataFrame:
    """M11 for more than ``grid_dims`` dimensions: every pair of different points within eps
    (grid of side eps on the first dimensions, then the full distance). Identical points are
    merged first (weight = multiplicity): they are one another's neighbours, and all core or
    none, so pairs grow with the different points only."""
    v = F.col(vec).cast("array<double>")
    pts = (df.select(F.col(id_col).alias("_id"), v.alias("v")).groupBy("v")
           .agg(F.min("_id").alias("pid"), F.count(F.lit(1)).alias("w"))).transform(materialize)
    pairs = neighbour_pairs(pts, "pid", "v", eps, grid_dims).transform(materialize)
    weights = pts.groupBy(F.col("pid").alias("b")).agg(F.sum("w").alias("w"))
    counts = (pairs.distinct().join(weights, "b").groupBy(F.col("a").alias("node"))
              .agg(F.sum("w").alias("n_nb")))
    core = counts.where(F.col("n_nb") >= min_samples).select("node").transform(materialize)
    core_ids = core.withColumnRenamed("node", "a")
    core_edges = (pairs.where("a != b").join(core_ids, "a", "left_semi")
                  .join(core_ids.withColumnRenamed("a", "b"), "b", "left_semi"))
    comp = connected_min_labels(core, core_edges).transform(materialize)
    numbers = dense_codes(comp, "label", "cluster")
    core_lab = comp.join(numbers, "label").select("node", "cluster")
    border = (pairs.join(core_lab.select(F.col("node").alias("b"), "cluster"), "b")
              .join(core.withColumnRenamed("node", "a"), "a", "left_anti")
              .groupBy(F.col("a").alias("node")).agg(F.min("cluster").alias("cluster")))
    labelled = core_lab.withColumn("is_core", F.lit(True)).unionByName(
        border.withColumn("is_core", F.lit(False)))
    point_lab = pts.select("v", F.col("pid").alias("node")).join(labelled, "node").select("v", "cluster", "is_core")
    return (df.select(F.col(id_col), v.alias("v")).join(point_lab, "v", "left")
            .select(id_col, F.coalesce("cluster", F.lit(-1)).cast("long").alias("cluster"),
                    F.coalesce("is_core", F.lit(False)).alias("is_core")))
